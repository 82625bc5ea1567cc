"""Embeddings of texts that have none yet, by encoders that are chosen by name.

The local encoder hashes tokens to a fixed number of features, weights them by idf, and projects them at random:
every feature has a vector of signs, and a text's vector is the weighted sum of its features' vectors, at length
one. Inner products estimate the cosines of the tf-idf vectors, with a standard error of about one over the root of the
dimension; at 1,024 dimensions the rank correlation with exact cosines is 0.97 among pairs above 0.05, and 0.79 over all
pairs, most of which share next to nothing (tests/test_sources.py). The idf table has one row a feature at most, so what goes to the tasks doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import corpus_tokens

FEATURES, DIM = 1 << 16, 1024
#: Encoders that send texts elsewhere: none is part of this library, and one is used only with both approvals.
REMOTE = ("voyage", "jina", "openai")


def feature(token: Column, features: int = FEATURES) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(features)).cast("int")


def feature_idf(docs: DataFrame, text: str = "text", features: int = FEATURES) -> DataFrame:
    """(feature, idf): smoothed, over documents with text; `features` rows at most."""
    some = docs.where(F.trim(text) != "")
    each = some.select(F.explode(F.array_distinct(F.transform(corpus_tokens(text), lambda t: feature(t, features)))).alias("feature"))
    n = some.agg(F.count("*").alias("n"))
    return each.groupBy("feature").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("feature", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def signs(features: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """The sign vector of each feature, from a counter-based mix: any task makes the same ones."""
    lane = np.arange(-(-dim // 64), dtype=np.uint64)
    x = (features.astype(np.uint64)[:, None] << np.uint64(20)) + lane[None, :] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(features), -1), axis=1)[:, :dim]
    return bits.astype(np.float32) * 2 - 1


def projected(features: np.ndarray, weights: np.ndarray, first: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Unit vectors of texts from their features and weights; text i has those from first[i] to first[i + 1]."""
    known, at = np.unique(features, return_inverse=True)
    table = signs(known, dim, seed)
    out = np.zeros((len(first) - 1, dim), dtype=np.float32)
    for i in range(len(out)):
        a, b = first[i], first[i + 1]
        out[i] = weights[a:b].astype(np.float32) @ table[at[a:b]] if b > a else 0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def hashed_vectors(items: DataFrame, idf: DataFrame, key: str, text: str = "text", dim: int = DIM, features: int = FEATURES, seed: int = 1) -> DataFrame:
    """(key, embedding). Tokens and features are worked out in the JVM, the projection in Arrow batches; features without idf weigh nothing.

    A text without a known token has the zero vector.
    """
    import pyarrow as pa

    if dim <= 0 or features > 1 << 20:
        raise ValueError("dim must be positive and features 2^20 at most")
    weights = np.zeros(features, dtype=np.float32)
    for r in idf.collect():  # a row a feature, and their number is a parameter
        weights[r["feature"]] = r["idf"]
    sent = items.sparkSession.sparkContext.broadcast(weights)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            first = np.asarray(lists.offsets, dtype=np.int64)
            flat = np.asarray(lists.flatten(), dtype=np.int64)
            vectors = projected(flat, sent.value[flat], first - first[0], dim, seed)
            offsets = pa.array(np.arange(len(vectors) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel(), pa.float32()))], names=[key, "embedding"])

    counted = items.select(key, F.coalesce(F.transform(corpus_tokens(text), lambda t: feature(t, features)), F.array().cast("array<int>")).alias("features"))
    return counted.mapInArrow(encode, f"`{key}` {items.schema[key].dataType.simpleString()}, embedding array<float>")


Encoder = Callable[[DataFrame, str, str], DataFrame]


def local_encoder(corpus: DataFrame, text: str = "text", dim: int = DIM) -> tuple[str, Encoder]:
    """(model name, encoder) with the idf of a corpus."""
    idf = feature_idf(corpus, text)
    return f"hash-{dim}", lambda items, key, column: hashed_vectors(items, idf, key, column, dim)


def encoder(name: str, encoders: dict[str, tuple[str, Encoder]], approved: bool = False, token: str | None = None) -> tuple[str, Encoder]:
    """An encoder by name. One that sends texts elsewhere needs the caller's flag and a token file that isn't empty."""
    if name in REMOTE and not (approved and token and Path(token).is_file() and Path(token).read_text().strip()):
        raise PermissionError(f"{name} sends texts elsewhere: approval and a token file are needed")
    if name not in encoders:
        raise ValueError(f"no encoder {name}; there are {sorted(encoders)}")
    return encoders[name]


def embed_missing(items: DataFrame, verdicts: DataFrame, vectors: DataFrame, model: tuple[str, Encoder], key: str = "canonical_id", text: str = "text", limit: int | None = None) -> DataFrame:
    """(key, model_name, embedding) of items in scope that have text and no vector of this model yet.

    verdicts: key, is_lab_relevant, where missing and null keep an item; vectors: key, model_name. limit: the first so many
    by key, before blank texts go. Of items that share a key the one with the largest text is encoded.
    """
    name, run = model
    refused = verdicts.where(~F.coalesce("is_lab_relevant", F.lit(True))).select(key)
    have = vectors.where(F.col("model_name") == name).select(key)
    todo = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(text).alias(text)).join(refused, key, "left_anti").join(have, key, "left_anti")
    if limit is not None:
        todo = todo.orderBy(key).limit(limit)
    return run(todo.where(F.trim(text) != ""), key, text).select(key, F.lit(name).alias("model_name"), "embedding")
