"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a score, the logistic function of the sum of its
words' weights; the document's score is their noisy-or, the chance that at least one sentence is toxic.
Only documents have labels: the gradient of the document's likelihood reaches each sentence in
proportion to its own score, so the weights settle on the sentences that explain the label, and these
are then reported as the offending ones.

The weights are learned on the driver from a bounded sample of labelled rows (about TRAIN_ROWS whole
documents; those longer than TRAIN_CHARS characters are left out of it) and sent out as one table of fixed
size. Scoring goes through whole texts.

Defined results: a null or empty text, or one without letters, has no sentence and scores 0; equal texts
get equal scores; without labelled rows every score is 0; labels of 0 and 1 count, null labels don't, and
of several labels of a document the highest; an empty table has an empty result; columns of the input
stay, but those that have the names of the two results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import held_out, small_batches, table
from folioflow.llm.wordhash import words_of

TRAIN_ROWS, TRAIN_CHARS = 8_000, 20_000
DIM_BITS = 18
LARGEST = (1 << 63) - 1
#: About one word in a million without any bearing passes this.
SCREEN = 24.0
THRESHOLD = 0.3
#: Words are runs of letters (bytes beyond ASCII are letters); sentences end at these marks.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
ENDS = np.zeros(256, dtype=bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Bags:
    """Sentences of several documents: feature of each word, where sentences begin, whose they are."""

    feature: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    span: np.ndarray  # first and last byte of each sentence's words, within its document
    n_docs: int


def bags_of(texts: list[bytes]) -> Bags:
    w = words_of(texts, fold=True, breaks=NO_LETTER)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    nth = np.cumsum(ENDS[w.raw])[w.start]
    new = np.flatnonzero(np.concatenate([[True], (nth[1:] != nth[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, dtype=np.int64)
    last = np.append(new[1:], len(doc)) - 1
    offset = np.cumsum([0] + [len(t) + 1 for t in texts])[doc[new]]
    span = np.stack([w.start[new] - offset, w.end[last] - offset], axis=1) if len(new) else np.zeros((0, 2), dtype=np.int64)
    return Bags((w.hash >> np.uint64(64 - DIM_BITS)).astype(np.int64), new, doc[new], span, len(texts))


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin) if len(begin) else np.zeros(0)


def sentence_logits(bags: Bags, weights: np.ndarray, bias: float) -> np.ndarray:
    return _sums(weights[bags.feature], bags.begin) + bias


def document_scores(bags: Bags, logits: np.ndarray) -> np.ndarray:
    """Noisy-or: 1 - product of (1 - p)."""
    return -np.expm1(-np.bincount(bags.doc, weights=np.logaddexp(0, logits), minlength=bags.n_docs))


def telling(bags: Bags, labels: np.ndarray) -> np.ndarray:
    """Features that are surely commoner in positive documents: likelihood-ratio statistic above SCREEN."""
    doc = np.repeat(bags.doc, np.diff(np.append(bags.begin, len(bags.feature))))
    pairs = np.unique(doc * (1 << DIM_BITS) + bags.feature)
    doc, feature = pairs >> DIM_BITS, pairs & ((1 << DIM_BITS) - 1)
    n = np.bincount(feature, minlength=1 << DIM_BITS)
    pos = np.bincount(feature, weights=labels[doc], minlength=1 << DIM_BITS)
    base = labels.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(pos > 0, pos * np.log(pos / (n * base)), 0) + np.where(n > pos, (n - pos) * np.log((n - pos) / (n * (1 - base))), 0))
    return np.flatnonzero((n > 0) & (pos > n * base) & (g > SCREEN))


def gradient(w: np.ndarray, word: np.ndarray, sentence: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope of the mean negative log-likelihood of the documents' labels; w ends with the bias, doc is each sentence's document."""
    z = np.bincount(sentence, weights=w[word], minlength=len(doc)) + w[-1]
    total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(labels))
    slope = np.where(labels > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
    per_sentence = slope[doc] / (1 + np.exp(-z)) / len(labels)
    return np.append(np.bincount(word, weights=per_sentence[sentence], minlength=len(w) - 1), per_sentence.sum())


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the documents' likelihood; only telling words get a weight."""
    bags = bags_of(texts)
    sentence = np.repeat(np.arange(len(bags.begin)), np.diff(np.append(bags.begin, len(bags.feature))))
    used = telling(bags, labels)
    place = np.full(1 << DIM_BITS, len(used))
    place[used] = np.arange(len(used))
    word = place[bags.feature]
    keep = word < len(used)
    word, sentence = word[keep], sentence[keep]
    w = np.zeros(len(used) + 1)  # the last one is the bias
    rate_pos = np.clip(labels.mean(), 1e-3, 0.5)
    w[-1] = np.log(rate_pos / max(1.0, len(bags.begin) / len(texts)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = gradient(w, word, sentence, bags.doc, labels)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << DIM_BITS, dtype=np.float32)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float] | None:
    """Learns from labelled rows; a hash of the key picks about `rows` of them when there are more."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_y"))
    n = known.count()
    if not n:
        return None
    if n > rows:
        at = F.shiftrightunsigned(F.xxhash64(key), 1)
        known = known.where(at < min(LARGEST, int(LARGEST * rows / n))).orderBy(at, key).limit(2 * rows)
    whole = docs.select(key, F.col(text).alias("_t"), F.xxhash64(key, text).alias("_h")).where(F.length("_t").between(1, TRAIN_CHARS))
    # At most 2 * rows ids are sent out. In one order, whatever the layout: sums of floats and so the model are the same.
    got = whole.join(F.broadcast(known), key).select("_h", "_t", "_y").orderBy("_h", "_t", "_y").limit(2 * rows).collect()
    y = np.array([r["_y"] for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return train([r["_t"].encode("utf-8", "surrogatepass") for r in got], y)


def score(df: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """df with score and offending (array of the sentences that score `least` or more, with their scores)."""
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c.lower() not in ("score", "offending")]
    place = keep.index(text)
    kind = T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("offending", kind)])
    arrow_kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(place).to_pylist()]
            scores, found = np.zeros(len(texts)), [[] for _ in texts]
            if held.value is not None and texts:
                bags = bags_of(texts)
                logits = sentence_logits(bags, *held.value)
                scores = document_scores(bags, logits)
                for i in np.flatnonzero(logits >= np.log(least / (1 - least))).tolist():
                    a, b = bags.span[i].tolist()
                    found[bags.doc[i]].append({"sentence": texts[bags.doc[i]][a:b].decode("utf-8", "replace"), "score": float(1 / (1 + np.exp(-logits[i])))})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, type=pa.float64()), pa.array(found, type=arrow_kind)], names=[*keep, "score", "offending"])

    return df.select(*keep).mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
