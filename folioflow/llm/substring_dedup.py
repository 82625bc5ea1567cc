"""Exact substring deduplication by prefix-partitioned suffix trees.

A window of 50 words that starts in an earlier document is removed from the later one. A suffix here starts
at an anchor: of the 20-word runs inside a window, the one with the least hash is where the window's suffix
begins. Equal windows have their anchor at the same place, and neighbouring windows mostly share one, so one
suffix stands for a run of windows that start up to 30 words before it.

1.  Suffixes are partitioned by their leading words, at first 20. Counting the prefixes (pre-aggregated)
    leaves those that several documents hold; the others cannot lead to a repeat.
2.  A prefix that more than HOT suffixes share is lengthened: the run of windows is halved, and the windows
    of each half have 35 words or more in common, which are the leading words of a suffix of their own (at
    the anchor, or 16 words before it). Prefixes that fit are packed into memory-sized groups, and a group's
    suffix tree is held as its sorted suffixes and the lengths of the common prefixes of neighbours: an
    internal node of depth d is an interval in which these are d or more. What stands before the anchors is
    a second tree, of the reversed left contexts. A window that starts k words before its anchor is a node
    of depth 50 - k in the one and of depth k in the other; nodes with several documents are repeats.
3.  A prefix that is still too common becomes the whole window. Its group is then a single node of depth 50
    and needs no tree, only the smallest document. What a document files under such a prefix is one row,
    however often it recurs, with each different window once; rows with equal windows are one class, so
    copies in any number are pre-aggregated.

Repeated windows in a row are one maximal repeat. Their places go back to their documents; the texts are
dealt out once and that exchange serves all joins.

Defined results: a null text has no words; texts under 50 words lose nothing; a null id counts as larger
than all others; documents with equal ids don't remove each other's windows; repeated rows are each
returned; windows are judged on the input; other columns, of any name, are ignored; an empty table has an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import small_batches, table, written
from folioflow.llm.wordhash import Words, mix, runs, runs_at, words_of

#: Words of a window, of the first prefix, and how many words before the anchor the farther half of a run has its own suffix.
WINDOW, GRAM, HALF = 50, 20, 16
#: Suffixes in one memory-sized group, and beyond which a prefix is lengthened.
GROUP, HOT = 4_000, 2_000
LAST = (1 << 63) - 1


def _texts(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def anchored(w: Words) -> tuple[np.ndarray, ...]:
    """(prefix hash, text, anchor, first window, last window, near, far) of each run of windows with one anchor.

    Places count within their text; near and far are the hashes of the longer prefixes of the two halves.
    """
    g = runs(w.hash, GRAM)
    span = WINDOW - GRAM + 1
    none = (np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 4, *[np.zeros(0, dtype=np.uint64)] * 2)
    if len(g) < span:
        return none
    value, at, width = g, np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        other = value[step:] < value[:-step]
        at = np.where(other, at[step:], at[:-step])
        value = np.where(other, value[step:], value[:-step])
        width += step
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[: len(value)]
    ok = np.flatnonzero(np.arange(len(value)) + WINDOW <= w.first[doc + 1])
    if not len(ok):
        return none
    new = np.concatenate([[True], (np.diff(ok) > 1) | (at[ok][1:] != at[ok][:-1]) | (doc[ok][1:] != doc[ok][:-1])])
    begin = np.flatnonzero(new)
    last = ok[np.append(begin[1:], len(ok)) - 1]
    first = ok[begin]
    base, place = w.first[doc[first]], at[first]
    near = runs_at(w.hash, place, WINDOW - HALF + 1)
    far = runs_at(w.hash, np.maximum(place - HALF, 0), GRAM + HALF)
    return g[place], doc[first], place - base, first - base, last - base, near, far


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns differ from the row before."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def _lists(ends: np.ndarray, **fields: np.ndarray) -> pa.ListArray:
    """Lists of structs, the first of which is [: ends[1]]."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields)))


def filed(docs: DataFrame) -> DataFrame:
    """(gram, _doc, _row, spans) of all suffixes, a row for each prefix of a document; docs has text, _doc, _row."""

    def run(batches):
        for batch in batches:
            gram, doc, at, s0, s1, near, far = anchored(words_of(_texts(batch.column(0))))
            order = np.lexsort((s0, gram, doc))
            gram, doc = gram[order], doc[order]
            new = _starts(doc, gram)
            own = pa.array(doc[new])
            places = {k: v[order].astype(np.int32) for k, v in (("at", at), ("s0", s0), ("s1", s1))}
            spans = _lists(np.append(new, len(doc)), **places, near=near[order].view(np.int64), far=far[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(gram[new].view(np.int64)), batch.column(1).take(own), batch.column(2).take(own), spans], names=["gram", "_doc", "_row", "spans"])

    return docs.select("text", "_doc", "_row").mapInArrow(run, "gram long, _doc long, _row long, spans array<struct<at:int,s0:int,s1:int,near:long,far:long>>")


def shared(entries: DataFrame) -> DataFrame:
    """entries of prefixes that several documents hold, with the number of suffixes of each prefix (cnt)."""
    counts = entries.groupBy("gram").agg(F.min("_doc").alias("lo"), F.max("_doc").alias("hi"), F.sum(F.size("spans")).alias("cnt")).where("lo < hi")
    return entries.join(counts.select("gram", "cnt"), "gram")


def lengthened(entries: DataFrame) -> DataFrame:
    """(gram, _doc, _row, spans) with the longer prefixes of the halves of each run.

    A longer prefix holds the shorter one at a fixed place, so each entry is lengthened on its own.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            entry = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at, s0, s1, near, far = (lists.flatten().field(k).to_numpy() for k in range(5))
            a, b = np.flatnonzero(s1 > at - HALF), np.flatnonzero(s0 <= at - HALF)
            entry, gram = np.concatenate([entry[a], entry[b]]), np.concatenate([near[a], far[b]])
            places = {"at": np.concatenate([at[a], at[b] - HALF]), "s0": np.concatenate([np.maximum(s0[a], at[a] - HALF + 1), s0[b]]), "s1": np.concatenate([s1[a], np.minimum(s1[b], at[b] - HALF)])}
            order = np.lexsort((places["s0"], gram, entry))
            entry, gram = entry[order], gram[order]
            new = _starts(entry, gram)
            own = pa.array(entry[new])
            spans = _lists(np.append(new, len(entry)), **{k: v[order].astype(np.int32) for k, v in places.items()})
            yield pa.RecordBatch.from_arrays([pa.array(gram[new]), batch.column(0).take(own), batch.column(1).take(own), spans], names=["gram", "_doc", "_row", "spans"])

    return entries.select("_doc", "_row", "spans").mapInArrow(run, "gram long, _doc long, _row long, spans array<struct<at:int,s0:int,s1:int>>")


def _per_document(filed_: DataFrame, docs: DataFrame) -> DataFrame:
    """text, _doc, _row and the list of what is filed from the document (bounded by its own length)."""
    each = filed_.groupBy("_doc", "_row").agg(F.collect_set(F.struct("gram", "spans")).alias("filed"))
    return docs.join(each, ["_doc", "_row"]).select("text", "_doc", "_row", "filed")


def _cut(batch) -> tuple[Words, np.ndarray, ...]:
    """Words of the batch; of each entry its document and prefix; of each of their runs the entry, anchor, first and last window in the batch's words."""
    w = words_of(_texts(batch.column(0)))
    lists = batch.column(3)
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    gram, spans = flat.field(0).to_numpy(), flat.field(1)
    entry = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
    at, s0, s1 = (spans.flatten().field(k).to_numpy() + w.first[doc[entry]] for k in range(3))
    return w, doc, gram, entry, at, s0, s1


def suffixes(per_doc: DataFrame, groups: int) -> DataFrame:
    """(grp, _doc, _row, at, s0, s1, words): the words s0 : s1 + WINDOW around each anchor, under the group of its prefix."""

    def run(batches):
        for batch in batches:
            w, doc, gram, entry, at, s0, s1 = _cut(batch)
            doc, gram = doc[entry], gram[entry]
            a, b = w.start[s0].tolist(), w.end[s1 + WINDOW - 1].tolist()
            raw = w.raw.tobytes()
            own = pa.array(doc)
            words = pa.array([raw[x:y] for x, y in zip(a, b, strict=True)], type=pa.binary())
            grp = (mix(gram.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
            places = [pa.array((x - w.first[doc]).astype(np.int32)) for x in (at, s0, s1)]
            yield pa.RecordBatch.from_arrays([pa.array(grp), batch.column(1).take(own), batch.column(2).take(own), *places, words], names=["grp", "_doc", "_row", "at", "s0", "s1", "words"])

    return per_doc.mapInArrow(run, "grp long, _doc long, _row long, at int, s0 int, s1 int, words binary")


class Tree:
    """Suffix tree of word sequences: their sorted order, and how many leading words neighbours in it have in common."""

    def __init__(self, rows: np.ndarray, size: np.ndarray):
        """rows: word numbers from 1 on, filled up with 0 behind `size` words."""
        n, width = rows.shape
        order = np.argsort(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * width))).ravel(), kind="stable") if width else np.arange(n)
        ranked, held = rows[order], size[order]
        differ = ranked[1:] != ranked[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(max(0, n - 1), dtype=np.int64)
        self.common = np.concatenate([[-1], np.minimum(common, np.minimum(held[1:], held[:-1]))])[:n]
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)

    def nodes(self, depth: int) -> np.ndarray:
        """For each sequence the first rank of the interval of those that share its first `depth` words."""
        return np.maximum.accumulate(np.where(self.common < depth, np.arange(len(self.common)), 0))[self.rank]


def _rows(number: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """Word numbers begin, begin + step, ... of each sequence as rows, filled up with 0."""
    k = np.arange(int(size.max()) if len(size) else 0)
    place = np.clip(begin[:, None] + step * k, 0, max(0, len(number) - 1))
    return np.where(k < size[:, None], number[place], 0).astype(np.int32)


def repeated_windows(words: list[bytes], doc: np.ndarray, at: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, window) of the windows that a smaller document holds too, in order, from the trees of a group."""
    w = words_of(words)
    number = pd.factorize(w.hash)[0] + 1
    left = at - s0
    anchor = w.first[:-1] + left
    right, before = Tree(_rows(number, anchor, s1 + WINDOW - at, 1), s1 + WINDOW - at), Tree(_rows(number, anchor - 1, left, -1), left)
    who, window = [], []
    for k in range(int((at - s1).min()), int(left.max()) + 1):
        own = np.flatnonzero((at - s1 <= k) & (k <= left))
        if len(own) < 2:
            continue
        name = pd.factorize(right.nodes(WINDOW - k)[own] * len(at) + before.nodes(k)[own])[0]
        least = np.full(int(name.max()) + 1, LAST)
        np.minimum.at(least, name, doc[own])
        hit = own[least[name] < doc[own]]
        who.append(hit)
        window.append(at[hit] - k)
    who, window = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (who, window))
    order = np.lexsort((window, who))
    return who[order], window[order]


def tree_repeats(suffix: DataFrame) -> DataFrame:
    """(_doc, _row, a, b): first and last of the repeated windows in a row, from the suffix trees of each group."""

    def run(t: pa.Table) -> pa.Table:
        doc, row, at, s0, s1 = (t.column(c).to_numpy().astype(np.int64) for c in ("_doc", "_row", "at", "s0", "s1"))
        who, window = repeated_windows(t.column("words").to_pylist(), doc, at, s0, s1)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(window) != 1) | (np.diff(who) != 0)])) if len(who) else who
        end = np.append(new[1:], len(who)) - 1 if len(who) else new
        return pa.table({"_doc": doc[who[new]], "_row": row[who[new]], "a": window[new].astype(np.int32), "b": window[end].astype(np.int32)})

    return suffix.groupBy("grp").applyInArrow(run, "_doc long, _row long, a int, b int")


def run_keys(per_doc: DataFrame) -> DataFrame:
    """(k1, k2, _doc, _row, windows, starts, places): what each document files under one gram.

    windows are 128 bits of each different window, in order; the window at word starts[i] is windows[places[i]];
    k1 and k2 name the set of windows.
    """

    def run(batches):
        for batch in batches:
            w, doc, _, entry, _, s0, s1 = _cut(batch)
            size = s1 - s0 + 1
            ends = np.concatenate([[0], np.cumsum(size)])
            at, entry = np.repeat(s0 - ends[:-1], size) + np.arange(ends[-1]), np.repeat(entry, size)
            w1, w2 = (runs(x, WINDOW)[at] if len(at) else np.zeros(0, dtype=np.uint64) for x in (w.hash, mix(w.hash ^ np.uint64(0x5851F42D4C957F2D))))
            order = np.lexsort((w2, w1, entry))
            new = _starts(entry[order], w1[order], w2[order])
            own = order[new]  # each window of an entry once
            first = np.searchsorted(entry[own], np.arange(len(doc) + 1))
            place = np.zeros(len(at), dtype=np.int64)
            place[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(at))))
            place -= first[entry]
            keys = [mix(np.add.reduceat(mix(x[own]), first[:-1])).view(np.int64) if len(own) else np.zeros(0, dtype=np.int64) for x in (w1, w2)]
            bounds = pa.array(np.searchsorted(entry, np.arange(len(doc) + 1)).astype(np.int32))
            starts, places = (pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (at - w.first[doc[entry]], place))
            windows = _lists(first, w1=w1[own].view(np.int64), w2=w2[own].view(np.int64))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), batch.column(1).take(take), batch.column(2).take(take), windows, starts, places], names=["k1", "k2", "_doc", "_row", "windows", "starts", "places"])

    return per_doc.mapInArrow(run, "k1 long, k2 long, _doc long, _row long, windows array<struct<w1:long,w2:long>>, starts array<int>, places array<int>")


def node_repeats(keys: DataFrame) -> DataFrame:
    """(_doc, _row, spans) of documents whose windows are their own prefixes; equal sets of windows are one row until the end."""
    classes = keys.groupBy("k1", "k2").agg(F.min("_doc").alias("lo"), F.first("windows").alias("windows"))
    each = classes.select("k1", "k2", "lo", F.posexplode("windows").alias("pos", "w")).select("k1", "k2", "lo", "pos", "w.w1", "w.w2")
    nodes = each.groupBy("w1", "w2").agg(F.min("lo").alias("first"), F.count("*").alias("n")).where("n > 1")
    earlier = each.join(nodes, ["w1", "w2"]).where("first < lo").groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "first")).alias("firsts"))
    known = classes.join(earlier, ["k1", "k2"], "left").select("k1", "k2", "lo", F.coalesce("firsts", F.array().cast("array<struct<pos:int,first:long>>")).alias("firsts"))

    def run(batches):
        for batch in batches:
            doc, lo = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            starts, places, firsts = batch.column(2), batch.column(3), batch.column(5)
            keep, a, b, ends = [], [], [], [0]
            for i in range(len(doc)):
                at, where = starts[i].values.to_numpy(), places[i].values.to_numpy()
                first = np.full(int(where.max()) + 1, lo[i])
                earlier = firsts[i].values
                first[earlier.field(0).to_numpy()] = earlier.field(1).to_numpy()
                at = np.sort(at[first[where] < doc[i]])
                if len(at):
                    new = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
                    keep.append(i)
                    a.append(at[new])
                    b.append(at[np.append(new[1:], len(at)) - 1])
                    ends.append(ends[-1] + len(new))
            take = pa.array(keep, type=pa.int64())
            none = np.zeros(0, dtype=np.int32)
            spans = _lists(np.array(ends), a=np.concatenate(a or [none]).astype(np.int32), b=np.concatenate(b or [none]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), spans], names=["_doc", "_row", "spans"])

    met = keys.drop("windows").join(known, ["k1", "k2"]).where((F.col("lo") < F.col("_doc")) | (F.size("firsts") > 0))
    return met.select("_doc", "_row", "starts", "places", "lo", "firsts").mapInArrow(run, "_doc long, _row long, spans array<struct<a:int,b:int>>")


def partitioned(named: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(entries for trees, entries for single nodes): gram, _doc, _row, spans, cnt, and n_prefix, the least length of the prefix.

    The first ones' prefixes have `hot` suffixes at most; the others' prefixes are their whole windows.
    """
    places = F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["s0"].alias("s0"), s["s1"].alias("s1")))
    first = written(filed(named), "substring-filed")
    kept = written(shared(first), "substring-shared", done=(first,))
    fits = kept.where(F.col("cnt") <= hot).withColumn("spans", places).withColumn("n_prefix", F.lit(GRAM))
    longer = written(shared(lengthened(kept.where(F.col("cnt") > hot))), "substring-longer")
    n_prefix = F.when(F.col("cnt") <= hot, WINDOW - HALF + 1).otherwise(WINDOW)
    longer = longer.withColumn("n_prefix", n_prefix)
    return fits.unionByName(longer.where(F.col("cnt") <= hot)), longer.where(F.col("cnt") > hot)


def removed_words(named: DataFrame, docs: DataFrame, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """(_doc, _row, spans): for each document that has any, first and last of its repeated windows.

    docs is named, dealt out by (_doc, _row).
    """
    trees, nodes = partitioned(named, hot)
    n = trees.agg(F.sum(F.size("spans"))).first()[0] or 0
    by_tree = tree_repeats(suffixes(_per_document(trees, docs), max(1, -(-n // group))))
    by_node = node_repeats(run_keys(_per_document(nodes, docs)))
    by_tree = by_tree.select("_doc", "_row", F.array(F.struct("a", "b")).alias("spans"))
    return by_tree.unionByName(by_node).groupBy("_doc", "_row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("_doc")).withColumn("_row", F.xxhash64("text"))


def maximal_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, group: int = GROUP) -> DataFrame:
    """(key, first_word, n_words): stretches of WINDOW words or more of which each window starts in a document with a smaller key."""
    small_batches(df.sparkSession)
    named = _named(df, key, text)
    spans = removed_words(named, named.repartition("_doc", "_row"), hot, group)
    # Windows of neighbouring anchors meet: a stretch goes on while its next window follows the last one.
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] + 1 >= s["a"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s)))
    whole = spans.select("_doc", F.explode(F.aggregate(F.array_sort("spans"), F.array().cast("array<struct<a:int,b:int>>"), step)).alias("s"))
    return whole.select(F.when(F.col("_doc") != LAST, F.col("_doc")).cast(df.schema[key].dataType).alias(key), F.col("s.a").alias("first_word"), (F.col("s.b") - F.col("s.a") + WINDOW).alias("n_words"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, group: int = GROUP) -> DataFrame:
    """(key, kept, n_words, n_removed), one row per row of df: kept is the text of the words that stay, joined by one space."""
    small_batches(df.sparkSession)
    named = _named(df, key, text)
    docs = named.repartition("_doc", "_row")
    spans = removed_words(named, docs, hot, group)
    schema = T.StructType([T.StructField("_doc", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in batches:
            w = words_of(_texts(batch.column(0)))
            change = np.zeros(len(w.start) + WINDOW + 1, dtype=np.int64)
            lists = batch.column(2)
            for i, spans_ in enumerate(lists.to_pylist()):
                for s in spans_ or ():
                    change[w.first[i] + s["a"]] += 1
                    change[w.first[i] + s["b"] + WINDOW] -= 1
            stay = np.cumsum(change)[: len(w.start)] == 0
            before = np.concatenate([[0], np.cumsum(stay)])
            n_kept = before[w.first[1:]] - before[w.first[:-1]]
            n_words = np.diff(w.first)
            raw = w.raw.tobytes()
            a, b = w.start[stay].tolist(), w.end[stay].tolist()
            kept = [b" ".join([raw[a[i] : b[i]] for i in range(x, y)]) for x, y in zip(before[w.first[:-1]].tolist(), before[w.first[1:]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(kept, type=pa.binary()).cast(pa.string()), pa.array(n_words.astype(np.int64)), pa.array((n_words - n_kept).astype(np.int64))], names=["_doc", "kept", "n_words", "n_removed"])

    out = docs.join(spans, ["_doc", "_row"], "left").select("text", "_doc", "spans").mapInArrow(run, schema)
    return out.select(F.when(F.col("_doc") != LAST, F.col("_doc")).cast(df.schema[key].dataType).alias(key), "kept", "n_words", "n_removed")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
