"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A random walk over a word sequence copies the current word and then steps on or not, by a random bit of
the word and the time (the embedding of Chakraborty, Goldenberg and Koucky). Sequences a few edits apart
soon walk in step again, so edit distance becomes Hamming distance. A bit-sampling hash keeps SAMPLED of
the walk's outputs; with REPEATS independent walks an item and a window within the edit limit agree in
at least one hash with the target recall (measured in tests). What agrees is verified by the exact edit
distance between the item and the best-fitting stretch of words there.

Windows have the size of the items. Within a limit of k edits, an item of n words keeps at least
n - q + 1 - qk of its runs of q words, all within k places of one diagonal, and one run at least; only
windows on such diagonals are embedded. This loses no match. A text with fewer words than the item is one
window, filled up with PAD, so what stands before or after it in a batch makes no difference.

The benchmark is the query set: blocks of bounded size go to all workers, however many there are, each block one
pass over the texts.

Defined results: words are runs of letters and digits, A-Z lower-cased; items and texts without words,
also null ones, match nothing; repeated rows are each reported, and so are null ids, of rows and of items; the limit
is EDITS of the item's words, rounded down, so items under five words must stand verbatim. An empty benchmark
matches nothing, an empty table has an empty result. leaks() reads only the columns it is told; clean() keeps all
columns, of any name, and all rows of an empty benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.llm.common import small_batches, table
from folioflow.llm.wordhash import mix, runs, words_of

EDITS = 0.2
REPEATS, SAMPLED = 16, 2
#: Items of a block at most, and characters of all its items at most unless one alone has more.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16 << 20
PAD = np.uint64(0x1234567890ABCDEF)
NO_WORD = np.ones(256, dtype=bool)
NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FILTER_BITS = 22
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def limit(n: int) -> int:
    return int(EDITS * n)


def whole_run(n: int) -> int:
    """Words of an item that stay together under the limit, 3 at most."""
    k = limit(n)
    return min(3, -(-(n - k) // (k + 1)))


@dataclass
class Items:
    """One block of the query set; a few hundred bytes an item."""

    ids: np.ndarray
    words: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # length -> sorted hash, item, place, filter
    codes: np.ndarray  # sorted hashes of (walk, item length, sampled outputs)
    code_item: np.ndarray
    plans: tuple[np.ndarray, np.ndarray]  # for each walk: odd multipliers of its steps, sampled times as shares of it


def walks(values: np.ndarray, start: np.ndarray, n: np.ndarray, end: np.ndarray, plans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(walks x windows) hash of the sampled outputs of each walk over values[start : start + n]; PAD from end, the end of the text, on."""
    odd, share = plans
    repeats, windows = len(odd), len(start)
    if not windows:
        return np.zeros((repeats, 0), dtype=np.uint64)
    which = np.repeat(np.arange(repeats), windows)
    start, n, held = np.tile(start, repeats), np.tile(n, repeats), np.tile(np.minimum(n, end - start), repeats)
    times = np.sort((share[which] * (3 * n[:, None])).astype(np.int64), axis=1)
    order = np.argsort(-times[:, -1], kind="stable")  # the walks that go on stand in front
    which, times, start, n, held = which[order], times[order], start[order], n[order], held[order]
    alive = np.searchsorted(-times[:, -1], -np.arange(int(times[0, -1]) + 1), side="right")
    at, code = np.zeros(len(start), dtype=np.int64), n.astype(np.uint64) * _FOLD
    inside = len(values) - 1
    for t, m in enumerate(alive.tolist()):
        here = at[:m]
        word = np.where(here < held[:m], values[np.minimum(start[:m] + here, inside)], PAD)
        for k in range(times.shape[1]):
            due = np.flatnonzero(times[:m, k] == t)
            code[due] = (code[due] ^ word[due]) * _FOLD + np.uint64(k + 1)
        here += ((word * odd[which[:m], t]) >> np.uint64(63)).astype(np.int64)
    out = np.empty(len(order), dtype=np.uint64)
    out[order] = mix(code) ^ which.astype(np.uint64)
    return out.reshape(repeats, windows)


def _objects(values: list) -> np.ndarray:
    """Values of any type, lists too, one a place."""
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def make_items(rows: list[tuple], seed: int = 11) -> Items | None:
    w = words_of([(t or "").encode("utf-8", "surrogatepass") for _, t in rows], fold=True, breaks=NO_WORD)
    n_all = np.diff(w.first)
    some = [i for i in range(len(rows)) if n_all[i]]
    if not some:
        return None
    words = [w.hash[w.first[i] : w.first[i + 1]] for i in some]
    n = np.array([len(x) for x in words])
    per: dict[int, list] = {}
    for i, x in enumerate(words):
        q = whole_run(len(x))
        per.setdefault(q, []).append((runs(x, q), np.full(len(x) - q + 1, i), np.arange(len(x) - q + 1)))
    grams = {}
    for q, parts in per.items():
        h, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        grams[q] = (h[order], item[order], place[order], seen)
    rng = np.random.default_rng(seed)
    plans = (rng.integers(1, 1 << 63, size=(REPEATS, 3 * int(n.max()) + 1), dtype=np.uint64) | np.uint64(1), rng.random((REPEATS, SAMPLED)))
    flat, begin = np.concatenate(words), np.concatenate([[0], np.cumsum(n)])[:-1]
    codes = walks(flat, begin, n, begin + n, plans).ravel()
    order = np.argsort(codes, kind="stable")
    return Items(_objects([rows[i][0] for i in some]), words, grams, codes[order], np.tile(np.arange(len(words)), REPEATS)[order], plans)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least word edits that turn item into some stretch of text, and where that stretch ends."""
    n = len(item)
    col = np.arange(n + 1)
    best, end = n, 0
    steps = np.arange(n + 1)
    for j, word in enumerate(text, 1):
        new = np.minimum(col[:-1] + (item != word), col[1:] + 1)
        # Inserting along the item: a running minimum, as each further word costs one.
        new = np.minimum.accumulate(np.concatenate([[0], new]) - steps) + steps
        col = new
        if col[-1] < best:
            best, end = int(col[-1]), j
    return best, end


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index) over the ranges lo[i] : hi[i]."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner]


def candidates(items: Items, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window start, item): windows of the texts that agree with an item in some sampled hash."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts, sizes = [], []
    length = np.array([len(x) for x in items.words])
    for q, (h, item, place, seen) in items.grams.items():
        g = runs(value, q)
        at = np.flatnonzero(seen[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = at[at + q <= first[doc[at] + 1]]
        lo, hi = np.searchsorted(h, g[at], "left"), np.searchsorted(h, g[at], "right")
        owner, k = _spread(lo, hi)
        begin = at[owner] - place[k]
        n = length[item[k]]
        # An edit breaks q runs at most, so about a match as many hits as are left lie close to one diagonal.
        edits = (EDITS * n).astype(np.int64)
        line = item[k] * (len(value) + (1 << 21)) + begin + (1 << 20)
        ranked = np.sort(line)
        near = np.searchsorted(ranked, line + edits, "right") - np.searchsorted(ranked, line - edits, "left")
        some = near >= n - q + 1 - q * edits
        owner, k, begin, n = owner[some], k[some], begin[some], n[some]
        # A window that leaves its text is moved into it; in a text with fewer words than the item it ends behind the text.
        begin = np.maximum(np.minimum(begin, first[doc[at[owner]] + 1] - n), first[doc[at[owner]]])
        starts.append(begin)
        sizes.append(n)
    start, size = (np.concatenate(x) for x in (starts, sizes))
    pairs = np.unique(start * (1 << 20) + size)
    start, size = pairs >> 20, pairs & ((1 << 20) - 1)
    code = walks(value, start, size, first[np.searchsorted(first, start, "right")], items.plans).ravel()
    owner, k = _spread(np.searchsorted(items.codes, code, "left"), np.searchsorted(items.codes, code, "right"))
    both = np.unique(start[owner % max(1, len(start))] * (1 << 24) + items.code_item[k])
    return both >> 24, both & ((1 << 24) - 1)


def matches(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, last word + 1) of the best place of each item in each text that holds it."""
    w = words_of([(t or "").encode("utf-8", "surrogatepass") for t in texts], fold=True, breaks=NO_WORD)
    if not len(w.hash):
        return []
    start, item = candidates(items, w.hash, w.first)
    doc = np.searchsorted(w.first, start, "right") - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    listed = {i: items.words[i].tolist() for i in np.unique(item).tolist()}
    for d, s, i in zip(doc.tolist(), start.tolist(), item.tolist(), strict=True):
        x = items.words[i]
        n, k = len(x), limit(len(items.words[i]))
        if (d, i) in best and best[d, i][0] == 0:
            continue
        low = int(w.first[d])
        if s + n <= w.first[d + 1] and np.array_equal(w.hash[s : s + n], x):
            edits, a, b = 0, s, s + n
        else:
            a, b = max(low, s - k), min(int(w.first[d + 1]), s + n + k)
            near = set(w.hash[a:b].tolist())
            if sum(map(near.__contains__, listed[i])) < n - k:  # a match keeps n - k of the item's words
                continue
            edits, end = edit_distance(x, w.hash[a:b])
            a, b = max(a, a + end - n), a + end
        if edits <= k and ((d, i) not in best or edits < best[d, i][0]):
            best[d, i] = (edits, a - low, b - low)
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


def _blocks(benchmark: DataFrame, key: Column, text: str) -> Iterator[Items | None]:
    """The query set in blocks of bounded size; the driver lists one block at a time. None where a block has no words."""
    rows: list[tuple] = []
    size = 0
    for r in benchmark.select(key.alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).toLocalIterator():
        if rows and (len(rows) >= BLOCK_ITEMS or size + len(r["text"]) > BLOCK_CHARS):
            yield make_items(rows)
            rows, size = [], 0
        rows.append((r["id"], r["text"]))
        size += len(r["text"])
    yield make_items(rows)


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, edits, first_word, end_word): one row for each text that holds a benchmark item. Keys and item ids may be of any type."""
    spark = df.sparkSession
    small_batches(spark, 1000)
    kind = benchmark.schema[item_key].dataType
    id_type = to_arrow_type(kind)
    out = None
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("item_id", kind), *[T.StructField(c, T.IntegerType()) for c in ("edits", "first_word", "end_word")]])
    for items in _blocks(benchmark, F.col(item_key), item_text):
        held = spark.sparkContext.broadcast(items)

        def run(batches, held=held):
            for batch in batches:
                found = matches(held.value, batch.column(1).to_pylist()) if held.value is not None else []
                at = pa.array([f[0] for f in found], type=pa.int64())
                ids = [held.value.ids[f[1]] for f in found]
                rest = [pa.array([f[k] for f in found], type=pa.int32()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(ids, type=id_type), *rest], names=["key", "item_id", "edits", "first_word", "end_word"])

        block = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
        out = block if out is None else out.unionByName(block)
    return out.withColumnRenamed("key", key)


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of df whose text holds no benchmark item; one pass in place, no shuffle for one block of items."""
    spark = df.sparkSession
    small_batches(spark, 1000)
    place = df.columns.index(text)
    for items in _blocks(benchmark, F.lit(None), item_text):
        if items is None:
            continue
        held = spark.sparkContext.broadcast(items)

        def run(batches, held=held):
            for batch in batches:
                bad = {f[0] for f in matches(held.value, batch.column(place).to_pylist())}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], type=pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
