"""Phrases in texts: one automaton holds a whole lexicon, and each text is scanned once for all of it.

The automaton is built once a task from a lexicon that is sent there; batches of texts pass through it in Arrow.
Matching disregards case: texts and phrases are lower-cased by Spark first. Null texts hold nothing, and blank
phrases stand nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from folioflow.functions.rounding import half_even

#: Characters of phrases that one automaton holds; it takes some fifty bytes for each. More phrases make more blocks.
BLOCK_CHARS = 1 << 20
#: Characters up to which a lexicon is one automaton where phrases compete for their spans.
LEXICON_CHARS = 4 << 20
#: Texts of a batch.
BATCH = 500


class Automaton:
    """(first character, phrase number) of every occurrence of some phrases in a text."""

    def __init__(self, phrases: list[str]):
        import ahocorasick

        self.phrases = phrases
        self.auto = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            if p:
                self.auto.add_word(p, i)
        if len(self.auto):
            self.auto.make_automaton()

    def ends(self, text: str) -> Iterator[tuple[int, int]]:
        """(last character, number), by last character."""
        return self.auto.iter(text) if len(self.auto) and text else iter(())

    def held(self, text: str) -> set[int]:
        return {i for _, i in self.ends(text)}

    def counts(self, text: str) -> dict[int, int]:
        """Phrase number -> occurrences that do not overlap, from the left."""
        out: dict[int, int] = {}
        behind: dict[int, int] = {}
        for last, i in self.ends(text):
            start = last - len(self.phrases[i]) + 1
            if start >= behind.get(i, 0):
                out[i], behind[i] = out.get(i, 0) + 1, last + 1
        return out

    def claimed(self, text: str, rank: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, number) by start: phrases take turns by rank, which never puts a shorter one first.

        A phrase looks at its occurrences from the left, each after the end of the last one that it looked at, and
        claims those in which no character is claimed yet.
        """
        places: dict[int, list[int]] = {}
        for last, i in self.ends(text):
            places.setdefault(i, []).append(last - len(self.phrases[i]) + 1)
        taken, out = bytearray(len(text) if places else 0), []
        for i in sorted(places, key=rank.__getitem__):
            size, free_from = len(self.phrases[i]), 0
            for start in places[i]:
                if start < free_from:
                    continue
                free_from = start + size
                # What is claimed is at least as long, so it covers an end of this span if it meets it.
                if not (taken[start] or taken[free_from - 1]):
                    taken[start:free_from] = b"\1" * size
                    out.append((start, free_from, i))
        return sorted(out)


_BUILT: dict[int, Automaton] = {}


def _automaton(sent) -> Automaton:
    """The automaton of a broadcast list of phrases; a worker keeps the last one it built."""
    if sent.value[0] not in _BUILT:
        _BUILT.clear()
        _BUILT[sent.value[0]] = Automaton(sent.value[1])
    return _BUILT[sent.value[0]]


def _send(spark: SparkSession, phrases: list[str]):
    import uuid

    return spark.sparkContext.broadcast((uuid.uuid4().int, phrases))


def smaller_batches(spark: SparkSession, rows: int = BATCH) -> None:
    """Whole texts: fewer rows in an Arrow batch, unless the session has still fewer."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def document_counts(docs: DataFrame, phrases: DataFrame, text: str = "text", phrase: str = "phrase", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(phrase, df): in how many rows of docs each distinct phrase stands.

    Phrases are dealt to blocks of bounded size, each one scan of the texts; tasks add up what their batches hold
    before anything is shuffled.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    smaller_batches(spark)
    listed = phrases.select(F.col(phrase).alias("phrase"), F.lower(phrase).alias("low")).where(F.trim("low") != "").distinct()
    lows = listed.select("low").distinct()
    size = lows.agg(F.sum(F.length("low"))).first()[0] or 0
    blocks = -(-size // block_chars)
    counts = spark.createDataFrame([], "low string, df long")
    for b in range(blocks):
        own = [r[0] for r in lows.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == b).collect()]
        sent = _send(spark, own)

        def count(batches, sent=sent):
            import numpy as np

            auto = _automaton(sent)
            total = np.zeros(len(auto.phrases), dtype=np.int64)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    total[list(auto.held(t))] += 1
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([auto.phrases[i] for i in some.tolist()], pa.string()), pa.array(total[some])], names=["low", "df"])

        counts = counts.unionByName(docs.where(F.col(text).isNotNull()).select(F.lower(text).alias("low")).mapInArrow(count, "low string, df long"))
    total = counts.groupBy("low").agg(F.sum("df").alias("df"))
    every = phrases.select(F.col(phrase).alias("phrase"), F.lower(phrase).alias("low")).where(F.col("low").isNotNull()).distinct()
    return every.join(total, "low", "left").select("phrase", F.coalesce("df", F.lit(0)).alias("df"))


def phrase_counts(docs: DataFrame, phrases: list[str], text: str = "text", out: str = "tf") -> DataFrame:
    """docs without text, and with `out`: how often each of the phrases stands in the lower-cased text, in their order.

    phrases are taken as they are, so they have to be lower-cased; a blank one stands nowhere.
    """
    import pyarrow as pa

    smaller_batches(docs.sparkSession)
    distinct = list(dict.fromkeys(p for p in phrases if p))
    at = {p: i for i, p in enumerate(distinct)}
    places = [at.get(p, -1) for p in phrases]
    sent = _send(docs.sparkSession, distinct)

    def count(batches):
        import numpy as np

        auto = _automaton(sent)
        where = np.array(places, dtype=np.int64)
        for batch in batches:
            tf = np.zeros((batch.num_rows, len(distinct) + 1), dtype=np.int32)  # the last place is that of blank phrases
            for k, t in enumerate(batch.column(1).to_pylist()):
                for i, n in auto.counts(t or "").items():
                    tf[k, i] = n
            offsets = pa.array(np.arange(batch.num_rows + 1) * len(where), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(tf[:, where].ravel(), pa.int32()))], names=["row", "tf"])

    others = [c for c in docs.columns if c != text]
    fed = docs.select(F.struct(*others).alias("row"), F.lower(text).alias("low"))
    schema = StructType([fed.schema["row"], StructField("tf", ArrayType(IntegerType()))])
    return fed.mapInArrow(count, schema).select("row.*", F.col("tf").alias(out))


def lexicon_list(lexicon: DataFrame, phrase: str = "phrase", place: str | None = None) -> list[tuple[str, str]]:
    """(phrase, lower-cased) of a lexicon, longest first, then by place if there is one, then by phrase; of equal lower-cased ones the first."""
    rows = lexicon.select(F.col(phrase).alias("phrase"), F.lower(phrase).alias("low"), (F.col(place) if place else F.lit(0)).alias("place")).where(F.trim("low") != "").distinct()
    size = rows.agg(F.sum(F.length("low"))).first()[0] or 0
    if size > LEXICON_CHARS:
        raise ValueError(f"a lexicon of {size} characters; phrases that compete for spans are bounded to {LEXICON_CHARS}")
    out: dict[str, str] = {}
    for r in sorted(rows.collect(), key=lambda r: (-len(r["low"]), r["place"], r["phrase"])):
        out.setdefault(r["low"], r["phrase"])
    return [(p, low) for low, p in out.items()]


def phrase_spans(docs: DataFrame, lexicon: DataFrame, text: str = "text", phrase: str = "phrase", place: str | None = None) -> DataFrame:
    """The other columns of docs with (phrase, start, end): greedy hits, longest phrases first; places are characters of the lower-cased text."""
    import pyarrow as pa

    spark = docs.sparkSession
    smaller_batches(spark)
    ordered = lexicon_list(lexicon, phrase, place)
    sent = _send(spark, [low for _, low in ordered])
    names = [p for p, _ in ordered]
    rank = list(range(len(ordered)))

    def scan(batches):
        auto = _automaton(sent)
        for batch in batches:
            rows, starts, ends, which = [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for a, b, i in auto.claimed(t or "", rank):
                    rows.append(k), starts.append(a), ends.append(b), which.append(names[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(which, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["row", "phrase", "start", "end"])

    others = [c for c in docs.columns if c != text]
    fed = docs.select(F.struct(*others).alias("row"), F.lower(text).alias("low"))
    schema = StructType([fed.schema["row"], StructField("phrase", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    return fed.mapInArrow(scan, schema).select("row.*", "phrase", "start", "end")


# --- fixed values of the fingerprint's first pass ----------------------------------------------------
CHANNEL_WEIGHTS = {"anchor": 1.0, "paradigm": 0.8, "context": 0.4}
#: Idf of a phrase that the corpus table does not have.
UNSEEN_IDF = 5.0


def channel_hits(texts: DataFrame, lexicon: DataFrame, idf: DataFrame, weights: dict[str, float] = CHANNEL_WEIGHTS) -> DataFrame:
    """(user, phrase, score, channels, n_hits) from texts (user, channel, text): the lexicon pass of a fingerprint.

    Each hit adds the weight of its channel times the phrase's idf (table phrase, idf; the case of phrases does not
    matter). Texts of other channels, and null users, are left out.
    """
    weight = F.coalesce(*[F.when(F.col("channel") == c, F.lit(w)) for c, w in weights.items()])
    known = texts.where(F.col("user").isNotNull() & F.col("channel").isin(list(weights))).select("user", "channel", "text")
    hits = phrase_spans(known, lexicon).groupBy("user", "channel", "phrase").agg(F.count("*").alias("n"))
    table = idf.groupBy(F.lower("phrase").alias("_low")).agg(F.max("idf").alias("_idf"))
    worth = hits.withColumn("_low", F.lower("phrase")).join(table, "_low", "left").withColumn("one", weight * F.coalesce("_idf", F.lit(UNSEEN_IDF)))
    return worth.groupBy("user", "phrase").agg(half_even(F.sum(F.col("n") * F.col("one")), 3).alias("score"), F.sort_array(F.collect_set("channel")).alias("channels"), F.sum("n").alias("n_hits"))
