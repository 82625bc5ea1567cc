"""URL filters by association rules.

Labelled URLs become baskets of tokens; FP-growth mines the token combinations that go with a bad label.
Rules are pruned by support, confidence and by a shorter rule that is as sure. An inverted index posts
each rule under its rarest token, so that a URL meets only the rules whose rarest token it holds; the
other tokens of the rule are then checked. Hand-written (host, path) rules overrule what is mined.

Everything runs as DataFrame operations. Defined results: a null URL, or one without "://", has an empty
host and path, no tokens, and the verdict "allow"; rows with equal URLs get equal verdicts, repeated rows one each; a null
page_id stays null and has no label; without labels, or with none that is bad, no rule is mined; an empty table has an empty
result; further columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import salted_left_join, table, written

BAD = "=bad"
#: (verdict, host, path): fixed by the query's contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Rules beyond this number are joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    rest = F.expr(f"CASE WHEN locate('://', `{url}`) > 0 THEN substring(`{url}`, locate('://', `{url}`) + 3) ELSE '' END")
    out = pages.withColumn("_rest", rest)
    host = F.regexp_extract("_rest", r"\A([^/?#]*)", 1)
    path = F.regexp_extract("_rest", r"\A[^/?#]*([^?#]*)", 1)
    return out.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path).drop("_rest")


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule and rule_verdict: of the rules that fit host or a parent domain and the path's start, the longest."""
    fits = [(v, h + p, (F.col("host").eqNullSafe(h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    first = F.coalesce(*[F.when(fit, F.struct(F.lit(name).alias("rule"), F.lit(v).alias("verdict"))) for v, name, fit in fits])
    return pages.withColumn("_r", first).withColumn("rule", F.col("_r.rule")).withColumn("rule_verdict", F.col("_r.verdict")).drop("_r")


def url_tokens(host: str = "host", path: str = "path", url: str = "url") -> Column:
    """Distinct tokens: host labels, path segments without numbers, names of query parameters."""
    hosts = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(F.lower(F.col(path)), r"[/._-]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$")), lambda x: F.concat(F.lit("p:"), x))
    names = F.transform(F.regexp_extract_all(F.coalesce(F.lower(F.col(url)), F.lit("")), F.lit(r"[?&]([a-z0-9_]+)="), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(hosts, segments, names))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_count: int = 20) -> DataFrame:
    """(tokens, confidence, support) of the rules tokens -> bad; labelled has tokens and the boolean bad.

    A rule needs min_support of the baskets and min_count of them, so that small tables yield no chance rules.
    """
    baskets = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    baskets = written(baskets.where(F.size("items") > 0), "url-baskets")
    support = min(1.0, max(min_support, min_count / max(1, baskets.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == BAD)
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    return rules


def prune(rules: DataFrame) -> DataFrame:
    """Drops a rule if a rule over some of its tokens is as sure; candidates meet by their tokens, not by pairs."""
    posted = rules.select(F.explode("tokens").alias("t"), F.col("tokens").alias("short"), F.col("confidence").alias("c"))
    met = rules.select(F.explode("tokens").alias("t"), "tokens", "confidence").join(posted, "t")
    beaten = met.where((F.size("short") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("short", "tokens")) == 0))
    return rules.join(beaten.select("tokens").distinct(), "tokens", "left_anti")


def inverted_index(rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """(token, tokens): each rule under the rarest of its tokens."""
    parts = rules.select("tokens", F.explode("tokens").alias("token")).join(token_counts, "token", "left")
    return parts.groupBy("tokens").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))


def flagged_urls(urls: DataFrame, index: DataFrame, n_rules: int) -> DataFrame:
    """URLs (url, tokens; one row each) that hold all tokens of some rule."""
    index = index.withColumnRenamed("tokens", "rule_tokens")
    index = F.broadcast(index) if n_rules <= BROADCAST_RULES else index
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.where(F.size(F.array_except("rule_tokens", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, min_support: float = 0.002, min_confidence: float = 0.5, min_count: int = 20) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (whether a mined rule flags the URL), one row per row of pages.

    labels: doc_id of the page, quality and toxic; a page is bad if it is toxic or of low quality.
    """
    base = with_rule(with_host_path(pages.select("page_id", "url"))).withColumn("tokens", url_tokens())
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    labelled = base.join(bad, base["page_id"] == bad["doc_id"]).select("tokens", "bad")
    mined = written(mine_rules(labelled, min_support, min_confidence, min_count), "url-rules")
    n_rules = mined.count()
    urls = base.where(F.col("url").isNotNull()).groupBy("url").agg(F.first("tokens").alias("tokens"))
    if n_rules:
        counts = base.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        index = written(inverted_index(prune(mined), counts), "url-index")
        flagged = flagged_urls(urls, index, n_rules).withColumn("mined", F.lit(True))
        base = salted_left_join(base, flagged, "url", F.col("page_id"))
    else:
        base = base.withColumn("mined", F.lit(False))
    mined_flag = F.coalesce("mined", F.lit(False))
    verdict = F.coalesce("rule_verdict", F.when(mined_flag, F.lit("block")).otherwise(F.lit("allow")))
    return base.select("page_id", "host", "path", "rule", verdict.alias("verdict"), mined_flag.alias("mined"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
