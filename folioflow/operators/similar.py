"""Pairs of similar titles: lossless at any share of copies and at any frequency of n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import lcs_masks, lcs_of
from folioflow.sources.scratch import written

#: Titles, and characters of them, that one side of a block holds at most on average.
BLOCK_TITLES, BLOCK_CHARS = 8192, 2_000_000
#: Bits of a title's unary letter counts, pairs whose bits are compared at once, and bins of the 2-grams that what is left has to pass.
BITS, AT_ONCE, BINS = 512, 1 << 15, 1024
#: Pairs that a task takes on average, as long as there are at most 2,000 tasks.
PAIRS_A_TASK = 10_000_000
#: Pairs that go through one filter together, and words that the masks or the characters of pairs take that are compared exactly together.
TOGETHER, WORDS = 4096, 1 << 22
#: Pairs of a title that are tried together where one of them is enough.
FIRST = 32


def length_band(a: Column, b: Column, least: float) -> Column:
    """Lossless: a ratio of at least `least` needs lengths this close."""
    return (2 * F.least(a, b)) >= F.lit(least) * (a + b)


class _Titles:
    """The titles of one side of a block, shortest first: lengths, and counts of n-grams in hashed bins."""

    def __init__(self, ids: pd.Series, titles: pd.Series):
        size = titles.str.len().to_numpy(np.int64)
        order = np.argsort(size, kind="stable")
        self.ids, self.titles, self.len = ids.to_numpy()[order], titles.to_numpy()[order], size[order]
        self.codes = np.frombuffer("".join(self.titles).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.len)))

    def counts(self, n: int, bins: int, most: int, kind: type) -> np.ndarray:
        """Counts of n-grams by bin, `most` at most; a thousand titles at a time."""
        out = np.zeros((len(self.len), bins), kind)
        for lo in range(0, len(self.len), 1024):
            hi = min(lo + 1024, len(self.len))
            codes = self.codes[self.start[lo] : self.start[hi]]
            row = np.repeat(np.arange(hi - lo), self.len[lo:hi])
            places = max(len(codes) - n + 1, 0)
            x = codes[:places]
            for k in range(1, n):
                x = x * np.uint64(1_000_003) + codes[k : k + places]
            if n > 1:
                x = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            whole = row[:places] == row[n - 1 :][:places]
            at = row[:places][whole] * bins + (x[whole] % np.uint64(bins)).astype(np.int64)
            out[lo:hi] = np.minimum(np.bincount(at, minlength=(hi - lo) * bins).reshape(hi - lo, bins), most)
        return out

    @cached_property
    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of 2-grams and their sums."""
        c = self.counts(2, BINS, 255, np.uint8)
        return c, c.sum(1, dtype=np.int64)


def _letter_bits(a: _Titles, b: _Titles) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts in unary, as words of 64 bits by title: so many bits differ as counts do, within the range that most titles lie in.

    Cutting a count to a range brings two counts nearer, never farther apart, so the bits that differ never exceed the edits.
    """
    both = [x.counts(1, 96, 65535, np.uint16) for x in (a, b)]
    seen = np.concatenate([x[:: max(1, len(x) // 512)] for x in both])
    low, high = np.percentile(seen, (1, 99), axis=0).astype(np.int64)
    wide = np.maximum(high - low, 0)
    if wide.sum() > BITS:
        kept = wide * BITS // wide.sum()
        low, wide = low + (wide - kept) // 2, kept
    bar = np.concatenate([np.arange(lo, lo + w) for lo, w in zip(low, wide, strict=True)]).astype(np.int64)
    letter = np.repeat(np.arange(96), wide)
    room = max(64, -(-len(bar) // 64) * 64)

    def bits(x: np.ndarray) -> np.ndarray:
        set_ = np.zeros((len(x), room), bool)
        set_[:, : len(bar)] = x[:, letter] > bar
        return np.ascontiguousarray(np.packbits(set_, axis=1).view(np.uint64).T)

    return bits(both[0]), bits(both[1])


def _met_by_letters(a: _Titles, b: _Titles, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs whose lengths and letter counts allow the ratio, some at a time."""
    bits_a, bits_b = _letter_bits(a, b)
    share_a, share_b = (((1 - least) * x.len + 1e-3).astype(np.float32) for x in (a, b))
    wide = (2 - least) / least
    step = max(1, AT_ONCE // len(b.len))
    few = range(0, len(bits_a), 3)
    for lo in range(0, len(a.len), step):
        hi = min(lo + step, len(a.len))
        first, last = np.searchsorted(b.len, a.len[lo] / wide - 1e-6), np.searchsorted(b.len, a.len[hi - 1] * wide + 1e-6, "right")
        if first == last:
            continue
        differ = np.zeros((hi - lo, last - first), np.uint16)
        for w in few:  # so few words that a byte holds their sum
            differ += sum(np.bitwise_count(wa[lo:hi, None] ^ wb[None, first:last]) for wa, wb in zip(bits_a[w : w + 3], bits_b[w : w + 3], strict=True))
        i, j = np.nonzero(differ <= share_a[lo:hi, None] + share_b[None, first:last])
        i, j = i + lo, j + first
        band = 2 * np.minimum(a.len[i], b.len[j]) >= least * (a.len[i] + b.len[j]) - 1e-6
        if band.any():
            yield i[band], j[band]


def _together(pairs: Iterator[tuple[np.ndarray, np.ndarray]], cut: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, TOGETHER at a time, or if nothing is to be cut, at least so many."""
    held, n = [], 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= TOGETHER:
            i, j = (np.concatenate(x) for x in zip(*held, strict=True))
            size = TOGETHER if cut else n
            whole = n - n % size
            for lo in range(0, whole, size):
                yield i[lo : lo + size], j[lo : lo + size]
            held, n = [(i[whole:], j[whole:])], n - whole
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _met_by_grams(a: _Titles, b: _Titles, pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of these pairs those whose 2-gram counts allow the ratio: an insertion or deletion changes three of them at most."""
    for i, j in pairs:
        (ca, na), (cb, nb) = a.grams, b.grams
        shared = np.minimum(ca[i], cb[j]).sum(1, dtype=np.uint32).astype(np.int64)
        ok = na[i] + nb[j] - 2 * shared <= 3 * (1 - least) * (a.len[i] + b.len[j]) + 1e-6
        yield i[ok], j[ok]


def _lcs_lengths(a: _Titles, b: _Titles, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of these pairs; lcs_of() for all of them in step, in words of 64 places of a."""
    letters = np.unique(np.concatenate([a.codes, b.codes]))
    wide, long = -(-int(a.len[i].max()) // 64), int(b.len[j].max())
    most = max(1, WORDS // max((len(letters) + 1) * wide, long))
    if len(i) > most:
        return np.concatenate([_lcs_lengths(a, b, i[lo : lo + most], j[lo : lo + most]) for lo in range(0, len(i), most)])
    # Calls of numpy outweigh whole numbers of any length where there are few pairs.
    if 9 * wide * (0.8 + 5e-4 * len(i)) > len(i) * (0.2 + 8e-3 * wide):
        return np.array([lcs_of(lcs_masks(a.titles[x]), int(a.len[x]), b.titles[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    own, at = np.unique(i, return_inverse=True)
    masks = np.zeros((wide, len(own) * (len(letters) + 1)), np.uint64)
    for k, x in enumerate(own.tolist()):
        place = np.arange(a.len[x])
        code = np.searchsorted(letters, a.codes[a.start[x] : a.start[x + 1]])
        np.bitwise_or.at(masks, (place // 64, k * (len(letters) + 1) + code), np.uint64(1) << (place % 64).astype(np.uint64))
    place = np.arange(long)[:, None]
    code = np.where(place < b.len[j], np.searchsorted(letters, b.codes[np.minimum(b.start[j] + place, len(b.codes) - 1)]), len(letters)) + at * (len(letters) + 1)
    row = np.full((wide, len(i)), np.uint64(2**64 - 1))
    for c in code:
        carry = np.uint64(0)
        for w in range(wide):
            old = row[w]
            hit = old & masks[w].take(c)
            total = old + hit + carry
            carry = (hit | (old & ~total)) >> np.uint64(63)
            row[w] = total | (old ^ hit)
    return 64 * wide - np.bitwise_count(row).sum(0, dtype=np.int64)


def _similar(a: _Titles, b: _Titles, pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of these pairs those that have the ratio, in their order: 2-grams, then exactly."""
    for i, j in _together(_met_by_grams(a, b, _together(pairs), least)):
        ok = 2 * _lcs_lengths(a, b, i, j) / (a.len[i] + b.len[j]) >= least
        yield i[ok], j[ok]


def _first_similar(a: _Titles, b: _Titles, pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: float, confirm: Callable[[str, str], bool]) -> Iterator[tuple[int, int]]:
    """For each title of a one similar pair that is confirmed, if it has any.

    All pairs of a title come together. Of each title without a pair FIRST are tried, then four times as many and so on, so a
    title that is like very many costs little more than these, and one that is like none fails with all of its own.
    """
    found = np.zeros(len(a.len), bool)
    for i, j in _together(pairs, cut=False):
        most = FIRST
        while len(i):
            now = np.arange(len(i)) - np.searchsorted(i, i) < most
            for some in _similar(a, b, iter([(i[now], j[now])]), least):
                for x, y in zip(*(p.tolist() for p in some), strict=True):
                    if not found[x] and confirm(a.titles[x], b.titles[y]):
                        found[x] = True
                        yield x, y
            left = ~now & ~found[i]
            i, j, most = i[left], j[left], most * 4


def similar_in_block(ids_a: pd.Series, titles_a: pd.Series, ids_b: pd.Series, titles_b: pd.Series, least: float, confirm: Callable[[str, str], bool] | None = None) -> Iterator[tuple]:
    """(id, id) of the titles of two sides with an indel ratio of at least `least`: letters, then 2-grams, then exactly.

    With confirm, one pair of each title of the first side that has a confirmed one.
    """
    a, b = _Titles(ids_a, titles_a), _Titles(ids_b, titles_b)
    met = _met_by_letters(a, b, least)
    if confirm is not None:
        yield from ((a.ids[x], b.ids[y]) for x, y in _first_similar(a, b, met, least, confirm))
        return
    for i, j in _similar(a, b, met, least):
        yield from zip(a.ids[i], b.ids[j], strict=True)


def similar_pairs(left: DataFrame, right: DataFrame | None, least: float, same: list[str] = (), confirm: Callable[[str, str], bool] | None = None) -> DataFrame:
    """(a, b) of the ids (canonical_id) of left and right whose titles (title_norm) have an indel ratio of at least `least`; lossless.

    Without right, the pairs within left, each once, a before b. same: columns that must be equal as well. Every row is taken
    as a title of its own: copies of a title belong in one row, and its members are joined to it afterwards.

    Titles lie in cells of lengths so wide that similar ones are in one cell or in neighbours; a cell's titles are dealt
    to slices of bounded size, and each two slices that may hold similar titles meet in one block. What a block costs depends on
    its number of titles only, not on how common their n-grams are: every pair's letter counts are compared, bit by bit.
    """
    one = right is None
    # A little wider than the widest ratio of lengths, for rounding.
    wide = (2 - least) / least * 1.0001

    def celled(df: DataFrame, name: str) -> DataFrame:
        usable = df.where((F.coalesce("title_norm", F.lit("")) != "") & F.expr(" AND ".join(["true", *(f"`{c}` IS NOT NULL" for c in same)])))
        return usable.select(F.col("canonical_id").alias("id"), *same, F.col("title_norm").alias("title"), F.floor(F.log(F.length("title_norm")) / F.log(F.lit(wide))).alias(f"cell_{name}"))

    def sized(df: DataFrame, name: str) -> DataFrame:
        slices = F.ceil(F.greatest(F.count("*") / BLOCK_TITLES, F.sum(F.length("title")) / BLOCK_CHARS))
        return df.groupBy(*same, f"cell_{name}").agg(slices.alias(f"slices_{name}"), F.count("*").alias(f"titles_{name}"))

    a = celled(left, "a")
    b = celled(left if one else right, "b")
    near = F.explode(F.array(*[F.col("cell_a") + k for k in ((0, 1) if one else (-1, 0, 1))]))
    grid = written(sized(a, "a").withColumn("cell_b", near).join(sized(b, "b"), [*same, "cell_b"]), "title-blocks")
    met = grid.agg(F.sum(F.col("titles_a").cast("double") * F.col("titles_b"))).first()[0] or 0
    tasks = int(min(max(met / PAIRS_A_TASK, 2 * left.sparkSession.sparkContext.defaultParallelism), 2000))
    keys = [*same, "cell_a", "cell_b", "slice_a", "slice_b"]

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(f"slices_{own}")).cast("int")
        met = df.join(grid.drop("titles_a", "titles_b"), [*same, f"cell_{own}"]).withColumn(f"slice_{own}", mine)
        out = met.withColumn(f"slice_{other}", F.explode(F.sequence(F.lit(0), F.col(f"slices_{other}").cast("int") - 1)))
        if one:
            out = out.where("cell_a < cell_b OR slice_a <= slice_b")
        # A number of its own: what a block costs is not seen in its bytes, by which partitions would be put together.
        return out.select(*[F.col(k).alias(k) for k in keys], "id", "title").repartition(tasks, *keys)

    def compare(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        pairs = similar_in_block(x["id"], x["title"], y["id"], y["title"], least, confirm) if len(x) and len(y) else ()
        if one:
            alone = key[-4] == key[-3] and key[-2] == key[-1]
            pairs = ((min(p), max(p)) for p in pairs if not alone or p[0] < p[1])
        return pd.DataFrame(list(pairs), columns=["a", "b"])

    kind = dict(a.dtypes)["id"], dict(b.dtypes)["id"]
    return dealt(a, "a", "b").groupBy(*keys).cogroup(dealt(b, "b", "a").groupBy(*keys)).applyInPandas(compare, f"a {kind[0]}, b {kind[1]}")
