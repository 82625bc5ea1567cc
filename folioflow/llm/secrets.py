"""Secret scans by corpus-wide ownership frequency.

Regular expressions find candidates in whole texts. Each candidate's value is hashed, and the corpus is
asked in how many distinct repositories and by how many distinct owners the hash occurs. A value of one
owner looks live, in however many repositories the owner keeps it. A value of several owners is a copied
example if there are more than max_owners of them, or more than max_repos repositories; a few copies, as
forks and mirrors make them, still look live. The fixed kinds (assign, access, hex) are always reported
with that class; the further kinds only where they look live and don't overlap a fixed one. The last kind
is no pattern of secrets at all: a long run of mixed characters anywhere is a candidate, and only that
the whole corpus has one owner for it makes it one.

Everything runs as DataFrame operations. Texts are searched once and never shuffled by scan; redact deals
out only those that hold a candidate. Counting distinct owners and repositories is pre-aggregated, and a
value that very many rows hold is split when it is joined back, so it does not meet in one task.

Defined results: a null text is the empty text, which has no spans; a null owner counts as one owner of
its own, likewise a null repository; repeated rows are reported each; further columns, of any name, are
ignored by scan and kept by redact; an empty table has an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import salted_left_join, table, written

#: kind, pattern, group that is the value, least length of the value: fixed by the query's contract.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # shorter runs fail, so they need not be matched
]
#: What only the ownership frequency can tell from examples.
FURTHER = [
    ("vendor", r"(?:gh[pousr]_|glpat-|sk_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{20,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s+[A-Za-z0-9+/=\s]{32,}", 0, 48),
    ("quoted", r"""(?<=["'])[A-Za-z0-9+/_=-]{24,}(?=["'])""", 0, 24),
]
#: Runs without a pattern of their own: long, of small and capital letters and digits, of many different characters, outside all other spans.
TOKEN = ("token", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
TOKEN_CHARACTERS = 12
#: Owners, and repositories of several owners, up to which a value looks live.
MAX_OWNERS, MAX_REPOS = 2, 8
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of spans of one kind: what lies between matches gives their places, in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        value = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(value) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zipped = F.zip_with(whole, between, lambda hit, gap: F.struct(gap.alias("gap"), hit.alias("hit")))
    zipped = F.filter(zipped, lambda x: x["hit"].isNotNull())
    none = F.array().cast(f"array<{SPAN}>")
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_spans and further_spans, each ordered by start and then by kind as listed."""
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = [(i, *k) for i, k in enumerate([*BASE, *FURTHER])]
    base = F.array_sort(F.concat(*[_spans(t, *k) for k in kinds[: len(BASE)]]))
    out = df.withColumn("base_spans", base)
    clear = lambda of: lambda x: ~F.exists(of, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    out = out.withColumn("_known", F.filter(F.concat(*[_spans(t, *k) for k in kinds[len(BASE) :]]), clear("base_spans")))
    mixed = lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]") & (F.size(F.array_distinct(F.split(x["value"], ""))) >= TOKEN_CHARACTERS)
    tokens = F.filter(_spans(t, len(kinds), *TOKEN), mixed)
    out = out.withColumn("_tokens", F.filter(F.filter(tokens, clear("base_spans")), clear("_known")))
    return out.withColumn("further_spans", F.concat("_known", "_tokens")).drop("_known", "_tokens")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) from candidates (hash, repo, owner)."""
    named = candidates.select("hash", F.coalesce(F.col("repo").cast("string"), F.lit("\0null")).alias("repo"), F.coalesce(F.col("owner").cast("string"), F.lit("\0null")).alias("owner"))
    return named.groupBy("hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def _list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def is_live(max_owners: int, max_repos: int) -> Column:
    """Over n_repos and n_owners of a value."""
    return (F.col("n_owners") == 1) | ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def searched(rows: DataFrame) -> DataFrame:
    """rows (text and others) with base_spans, further_spans and a number for each row, without text, as a written table."""
    return written(with_spans(rows).drop("text").withColumn("row", F.monotonically_increasing_id()), "secret-spans")


def classified(found: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """(row, spans) of the rows with candidates, with the class of each value; found has row, repo, owner and both lists of spans."""
    all_spans = F.concat("base_spans", "further_spans")
    each = found.where(F.size(all_spans) > 0).select("row", "repo", "owner", F.explode(all_spans).alias("s")).withColumn("hash", F.md5(F.col("s.value").cast("binary")))
    joined = salted_left_join(each.drop("repo", "owner"), ownership(each.select("hash", "repo", "owner")), "hash", F.col("row"))
    live = is_live(max_owners, max_repos) & ((F.col("s.kind") != TOKEN[0]) | (F.col("n_owners") == 1))
    span = F.struct("s.start", "s.rank", "s.end", "s.kind", "s.value", "n_repos", "n_owners", live.alias("live"))
    kept = F.when(live | (F.col("s.rank") < len(BASE)), span)
    return joined.groupBy("row").agg(F.array_sort(F.collect_list(kept)).alias("spans"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of df: key, base_spans, spans (array of start, rank, end, kind, value, n_repos, n_owners, live)."""
    found = searched(df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner")))
    spans = classified(found, max_owners, max_repos)
    full = found.where(F.size("base_spans") + F.size("further_spans") > 0).join(spans, "row").select("key", "base_spans", "spans")
    empty = found.where(F.size("base_spans") + F.size("further_spans") == 0).select("key", "base_spans", F.array().cast(full.schema["spans"].dataType).alias("spans"))
    return full.unionByName(empty).withColumnRenamed("key", key)


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, mark: str = "[SECRET]") -> DataFrame:
    """df with every live-looking value in text replaced by a mark; other rows, columns and texts are unchanged.

    A value that looks live goes wherever it stands in its row's text, inside longer words too.

    Rows without candidates pass by; the others meet their spans by row number.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found = searched(df.select(doc.alias("doc"), F.col(text).alias("text"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner")))
    some = F.size("base_spans") + F.size("further_spans") > 0
    values = F.array_distinct(F.transform(F.filter("spans", lambda s: s["live"]), lambda s: s["value"]))
    # Longer values first, so that one inside another does not break it.
    values = F.array_sort(values, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    spans = classified(found.select("row", "repo", "owner", "base_spans", "further_spans"), max_owners, max_repos).select("row", values.alias("values"))
    clean = F.aggregate("values", F.col(f"doc.`{text}`"), lambda x, v: F.replace(x, v, F.lit(mark)))
    masked = found.where(some).join(spans, "row").select(F.col("doc").withField(f"`{text}`", clean).alias("doc"))
    return masked.unionByName(found.where(~some).select("doc")).select("doc.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(_list(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _list(F.col("spans")).alias("spans"), live)
