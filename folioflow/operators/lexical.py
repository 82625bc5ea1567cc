"""Corpus statistics, phrases and facet tags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import fixed_values as V
from folioflow.functions.text import count_of
from folioflow.operators.phrases import BLOCK_CHARS, Automaton, document_counts, smaller_batches


def smoothed_idf(df_col, n: Column) -> Column:
    return F.log((n + 1) / (F.col(df_col) + 1)) + 1


def corpus_idf(docs: DataFrame, tokens: Column, min_df: int = 1) -> DataFrame:
    """(token, df, idf) over documents with text; distinct tokens per document."""
    n = docs.where(F.coalesce(F.trim("text"), F.lit("")) != "").agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.join(F.broadcast(n)).select("token", "df", smoothed_idf("df", F.col("n")).alias("idf"))


def phrase_idf(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, df, idf): in how many documents a phrase stands, as plain containment without regard to case; one scan for all phrases of a block."""
    n = docs.where(F.coalesce(F.trim("text"), F.lit("")) != "").agg(F.count("*").alias("n"))
    return document_counts(docs, phrases).join(F.broadcast(n)).select("phrase", "df", smoothed_idf("df", F.col("n")).alias("idf"))


def top_terms(scored: DataFrame, group: list[str], score: str, token: str, k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(score), token)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_phrase_scores(hits: DataFrame, by: list[str]) -> DataFrame:
    """Sums scores and hits of a phrase over channels and projects; the channels become a sorted set."""
    return hits.groupBy(*by, "phrase").agg(F.sum("score").alias("score"), F.sort_array(F.collect_set("channel")).alias("channels"), F.count("*").alias("n_hits"))


def match_kind(term) -> Column:
    """Phrases and non-ASCII terms match as substrings; short or upper-case ones as words."""
    t = F.col(term)
    return F.when(t.contains(" ") | ~t.rlike(r"^[\x00-\x7F]*$"), "sub").when((F.length(t) <= 5) | (t == F.upper(t)), "word").otherwise("sub")


def _word(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


class _Tagger:
    """Hits of taxonomy codes in a text: one automaton for substrings of the lower-cased text, one for words of the text itself."""

    def __init__(self, codes: list[tuple]):
        self.codes = codes  # (dim, code, [(term, lower-cased, kind)])
        self.at: dict[str, list[dict[str, list[tuple[int, int]]]]] = {}
        for kind, form in (("sub", 1), ("word", 0)):
            self.at[kind] = {}
            for c, (_, _, terms) in enumerate(codes):
                for k, t in enumerate(terms):
                    if t[2] == kind:
                        self.at[kind].setdefault(t[form], []).append((c, k))
        self.subs, self.words = (Automaton(list(self.at[k])) for k in ("sub", "word"))

    def hits(self, text: str, low: str) -> dict[int, set[int]]:
        """Code -> places of the terms that stand in the text."""
        found = {self.subs.phrases[i] for i in self.subs.held(low)}
        out: dict[int, set[int]] = {}
        for p in found:
            for c, k in self.at["sub"][p]:
                out.setdefault(c, set()).add(k)
        seen: set[int] = set()
        for last, i in self.words.ends(text):
            p = self.words.phrases[i]
            start = last - len(p) + 1
            # A word boundary: of two neighbours exactly one is a word character.
            if i not in seen and _word(text, start - 1) != _word(text, start) and _word(text, last) != _word(text, last + 1):
                seen.add(i)
                for c, k in self.at["word"][p]:
                    out.setdefault(c, set()).add(k)
        return out


def dim_tags(docs: DataFrame, taxonomy: DataFrame, top: int = V.TAG_TOP, least: float = V.TAG_LEAST, evidence: int = V.TAG_EVIDENCE, place: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, dim, code, hits, strength, rank, evidence): taxonomy has dim, code, term, and a column `place` where the order of terms matters.

    hits counts the terms of a code that stand in the text; strength is hits over the root of the number of terms, 1 at most;
    evidence lists the first terms that hit, by place or else by term. One scan of the texts finds all terms. A taxonomy of
    more than block_chars characters is dealt to blocks of whole codes, each a scan of its own; only then are tags
    shuffled to be ranked. Blank terms are left out; a null text has no tags.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    smaller_batches(spark)
    t = taxonomy.where(F.trim("term") != "").select("dim", "code", F.struct((F.col(place) if place else F.lit(0)).alias("place"), "term", F.lower("term").alias("low"), match_kind("term").alias("kind")).alias("t"))
    size = t.agg(F.sum(F.length("t.term"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, dim string, code string, hits int, strength double, rank int, evidence array<string>"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        own = t.where(F.pmod(F.xxhash64("dim", "code"), F.lit(blocks)) == b).groupBy("dim", "code").agg(F.array_sort(F.collect_list("t")).alias("terms"))
        codes = sorted((r["dim"], r["code"], [(x["term"], x["low"], x["kind"]) for x in r["terms"]]) for r in own.collect())
        sent = spark.sparkContext.broadcast(codes)

        def tag(batches, sent=sent):
            tagger = _Tagger(sent.value)
            for batch in batches:
                rows, made = [], []
                for i, (text, low) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    scored = []
                    for c, places in tagger.hits(text or "", low or "").items():
                        dim, code, terms = tagger.codes[c]
                        strength = min(1.0, len(places) / math.sqrt(len(terms)))
                        if strength >= least:
                            scored.append((dim, -strength, code, len(places), [terms[k][0] for k in sorted(places)[:evidence]]))
                    n: dict[str, int] = {}
                    for dim, strength, code, hits, terms in sorted(scored):
                        n[dim] = n.get(dim, 0) + 1
                        if n[dim] <= top:
                            rows.append(i)
                            made.append((dim, code, hits, -strength, n[dim], terms))
                types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.string())]
                cols = [pa.array([m[k] for m in made], x) for k, x in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *cols], names=["doc_id", "dim", "code", "hits", "strength", "rank", "evidence"])

        out = out.unionByName(docs.select("doc_id", "text", F.lower("text").alias("low")).mapInArrow(tag, schema)) if blocks > 1 else docs.select("doc_id", "text", F.lower("text").alias("low")).mapInArrow(tag, schema)
    if blocks == 1:
        return out
    # Each block kept its own leading codes of a row; the best of all are among them.
    w = Window.partitionBy("doc_id", "dim").orderBy(F.desc("strength"), "code")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def normalized_priors(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Each value over the largest of its group."""
    return scores.withColumn("prior", F.try_divide(F.col(value), F.max(value).over(Window.partitionBy(*by))))


def bm25_phrases(text, phrases) -> Column:
    """Matched phrases by contribution, three at most."""
    text = text if isinstance(text, Column) else F.col(text)
    hit = F.filter(phrases, lambda p: count_of(text, p["phrase"]) > 0)
    ranked = F.array_sort(F.transform(hit, lambda p: F.struct((-p["score"] * count_of(text, p["phrase"])).alias("s"), p["phrase"].alias("phrase"))))
    return F.transform(F.slice(ranked, 1, 3), lambda x: x["phrase"])
