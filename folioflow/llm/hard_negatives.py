"""Hard-negative mining: a vantage-point tree over norm-augmented vectors.

A further component sqrt(M^2 - |x|^2), M the largest norm, turns inner products into distances: for a query q
with 0 there, d^2 = |q|^2 + M^2 - 2 q.x. Highest scores are nearest, and a window of scores is an annulus. A
small tree, fitted on a bounded sample, deals all rows to cells; the least and greatest distance of a
cell's rows from the vantage points above it are taken over all rows, so the cell's bounds hold for
every row. A cell is split by row number into blocks of bounded size, each task builds the block's own
tree, and queries go only to blocks whose cell may hold a score that they ask for. In a block, a query visits
leaves nearest first and stops when no leaf left may improve on the k rows that it has.

Two rounds: the nearest rows of an anchor's label (bounded from below by what the sample holds), then, in the
windows that follow from their scores, the nearest rows of other labels. Each block returns k rows at most for
an anchor and window, which are ranked by score and id. Distances prune only, with slack for their rounding; scores
are whole numbers and exact. Anchors are dealt in slices of bounded size, so no task holds all of them.

Defined results: a null label, a null vector, or a null or non-finite component keeps a row out; so does a
component so large that inner products could leave 63 bits. Shorter vectors end in zeros. A null id is no anchor
and ranks behind all ids. An anchor's positives have other ids than its own; repeated rows count each. An
empty table has an empty result; further columns, of any name, are ignored. Labels are compared as text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import drop_written, table, written

#: Rows that the tree over cells is fitted on, and its cells.
SAMPLE, CELLS = 2048, 16
#: Rows of a block on average, rows of a leaf, and anchors of a slice.
BLOCK, LEAF, SLICE = 8192, 128, 4096
#: Relative slack of distances, far above the rounding of doubles.
SLACK = 1e-9
NONE = -(1 << 62) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two arrays of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


@dataclass
class Node:
    """A vantage point with the distance that splits the rows; `inner` and `outer` name a node, or a leaf as -1 - leaf."""

    vantage: int
    split: float
    inner: int = 0
    outer: int = 0


class Tree:
    """Vantage points are rows of x. `leaves`: row numbers, ascending; `paths`: (node, least, greatest distance) above each leaf."""

    def __init__(self, x: np.ndarray, most: float, leaf: int):
        self.x, self.most = x.astype(np.float64), most
        self.norm = (self.x**2).sum(1)
        self.more = np.sqrt(np.maximum(most - self.norm, 0))
        self.nodes: list[Node] = []
        self.leaves: list[np.ndarray] = []
        self.paths: list[list[tuple[int, float, float]]] = []
        todo = [(np.arange(len(x)), [], None)]
        while todo:
            rows, above, link = todo.pop()
            name = None
            if len(rows) > leaf:
                at = rows[np.argmax(self._between(rows[:1], rows)[0])]  # far from another row: distances spread
                d = self._between(np.array([at]), rows)[0]
                split = float(np.median(d))
                inner = d <= split
                if not inner.all():
                    name = len(self.nodes)
                    self.nodes.append(Node(int(at), split))
                    for side in (inner, ~inner):
                        r = (name, float(d[side].min()), float(d[side].max()))
                        todo.append((rows[side], [*above, r], (name, side is inner)))
            if name is None:
                name = -1 - len(self.leaves)
                self.leaves.append(rows)
                self.paths.append(above)
            if link:
                setattr(self.nodes[link[0]], "inner" if link[1] else "outer", name)
        self.points = np.array([n.vantage for n in self.nodes], dtype=np.int64)

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.most - 2 * (self.x[a] @ self.x[b].T + np.outer(self.more[a], self.more[b])), 0))

    def deal(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distances from the vantage points on the way, padded with zeros) of further rows."""
        v = self.x[self.points]
        more = np.sqrt(np.maximum(self.most - (x**2).sum(1), 0))
        d = np.sqrt(np.maximum(2 * self.most - 2 * (x @ v.T + np.outer(more, self.more[self.points])), 0))
        now = np.full(len(x), 0 if self.nodes else -1)
        way = np.zeros((len(x), max(map(len, self.paths))))
        for level in range(way.shape[1]):
            i = np.flatnonzero(now >= 0)
            way[i, level] = d[i, now[i]]
            at = [self.nodes[k] for k in now[i]]
            now[i] = [n.inner if z <= n.split else n.outer for n, z in zip(at, way[i, level], strict=True)]
        return -1 - now, way

    def scores(self, q: np.ndarray, paths: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(greatest, least) score that a query can have with a row of each leaf."""
        q = q.astype(np.float64)
        base = (q**2).sum(1) + self.most
        d = np.sqrt(np.maximum(base[:, None] - 2 * q @ self.x[self.points].T, 0))
        paths = self.paths if paths is None else paths
        near, far = np.zeros((len(q), len(paths))), np.full((len(q), len(paths)), np.inf)
        for leaf, path in enumerate(paths):
            for node, least, greatest in path:
                near[:, leaf] = np.maximum(near[:, leaf], np.maximum(d[:, node] - greatest, least - d[:, node]))
                far[:, leaf] = np.minimum(far[:, leaf], d[:, node] + greatest)
        slack = SLACK * (base + self.most)[:, None] + 1
        # No score lies beyond what both norms allow.
        edge = np.sqrt((q**2).sum(1) * self.most)[:, None]
        return np.minimum((base[:, None] - near**2) / 2, edge) + slack, np.maximum((base[:, None] - far**2) / 2, -edge) - slack


def nearest(x: np.ndarray, label: np.ndarray, own: np.ndarray, q: np.ndarray, q_label: np.ndarray, q_own: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, most: float, leaf: int = LEAF):
    """(score, row), queries by windows by k, NONE where there are fewer; ties go to the smaller row number.

    low and high: the windows of each query. same: only rows of the query's label and another id (own), else only rows of other labels.
    """
    tree = Tree(x, most, leaf)
    top, least = tree.scores(q)
    m, w = low.shape
    score, row = np.full((m, w, k), NONE, dtype=np.int64), np.full((m, w, k), len(x), dtype=np.int64)
    order = np.argsort(-top, axis=1, kind="stable")
    every = np.arange(m)
    for turn in range(len(tree.leaves)):
        at = order[:, turn]
        bound = top[every, at][:, None]
        open_ = (bound >= low) & (least[every, at][:, None] <= high) & (low <= high) & ~(score[:, :, -1] > bound)
        todo = open_.any(1)
        if not todo.any():
            if (bound < low.min(1, keepdims=True)).all():
                break
            continue
        for name in np.unique(at[todo]):
            i, rows = every[todo & (at == name)], tree.leaves[name]
            s = products(q[i], x[rows])
            equal = q_label[i][:, None] == label[rows][None, :]
            s[~(equal & (q_own[i][:, None] != own[rows][None, :]) if same else ~equal)] = NONE
            by = np.argsort(-s, axis=1, kind="stable")
            s, r = np.take_along_axis(s, by, 1), rows[by]
            width = s.shape[1]
            for j in range(w):
                begin = (s > high[i, j][:, None]).sum(1)
                place = begin[:, None] + np.arange(k)[None, :]
                inside = place < width
                place = np.minimum(place, width - 1)
                some = np.take_along_axis(s, place, 1)
                inside &= (some >= low[i, j][:, None]) & (some != NONE)
                s2 = np.concatenate([score[i, j], np.where(inside, some, NONE)], axis=1)
                r2 = np.concatenate([row[i, j], np.where(inside, np.take_along_axis(r, place, 1), len(x))], axis=1)
                best = np.lexsort((r2, -s2), axis=-1)[:, :k]
                score[i, j], row[i, j] = np.take_along_axis(s2, best, 1), np.take_along_axis(r2, best, 1)
    return score, row


def _matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.int64)
    return flat.reshape(len(column), width or len(flat) // max(len(column), 1))


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Equal values of several columns get equal numbers; nulls too."""
    both = pa.chunked_array([c for col in columns for c in col.cast(pa.string()).chunks], pa.string())
    codes = np.asarray(both.combine_chunks().dictionary_encode(null_encoding="encode").indices)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


class Index:
    """All rows, dealt to cells and blocks; written tables hold them."""

    def __init__(self, df: DataFrame, key: str, vector: str, label: str, scale: int, anchor: Column):
        x = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double") * scale)
        size = F.greatest(F.size(x), F.lit(1))
        limit = F.least(F.floor(F.sqrt(F.lit(2.0**62) / size)), F.lit(1 << 30))
        sound = F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v) < limit, F.lit(False)))
        rows = df.where(sound).select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.transform(x, lambda v: F.floor(v).cast("int")).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
        norm = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c)
        width, most, self.anchors = rows.agg(F.max(F.size("v")), F.max(norm), F.count_if("anchor")).first()
        self.width, self.most = max(width or 0, 1), float(most or 0)
        padded = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(self.width) - F.size("v"))))
        self.id_type = rows.schema["id"].dataType
        some = padded.orderBy(F.xxhash64("id", "row"), "row").limit(SAMPLE).select(F.col("id").cast("string").alias("id"), "label", "v").collect()
        self.sample = (np.array([r["v"] for r in some], dtype=np.int64).reshape(len(some), self.width), [r["label"] for r in some], [r["id"] for r in some])
        self.tree = Tree(self.sample[0], self.most, max(len(some) // CELLS, 1) + 1)
        self.rows = self._dealt(padded)
        drop_written(rows)
        levels = max(map(len, self.tree.paths))
        spans = [f(F.get("way", F.lit(i))) for i in range(levels) for f in (F.min, F.max)]
        cells = {r[0]: (r[1], r[2:]) for r in self.rows.groupBy("cell").agg(F.count("*"), *spans).collect()}
        self.paths = [[(node, cells[c][1][2 * i], cells[c][1][2 * i + 1]) for i, (node, *_) in enumerate(path)] if c in cells else [] for c, path in enumerate(self.tree.paths)]
        self.blocks = [-(-cells[c][0] // BLOCK) if c in cells else 0 for c in range(len(self.tree.paths))]

    def _dealt(self, padded: DataFrame) -> DataFrame:
        tree, width = self.tree, self.width

        def deal(batches):
            for b in batches:
                cell, way = tree.deal(_matrix(b.column(2), width).astype(np.float64))
                offsets = pa.array(np.arange(len(cell) + 1) * way.shape[1], pa.int32())
                distances = pa.ListArray.from_arrays(offsets, pa.array(way.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), distances], names=[*b.schema.names, "cell", "way"])

        schema = padded.select("id", "label", "v", "anchor", "row", F.lit(0).alias("cell"), F.array(F.lit(0.0)).alias("way")).schema
        return written(padded.select("id", "label", "v", "anchor", "row").mapInArrow(deal, schema), "cells")

    def routed(self, queries: DataFrame, same: int = 0) -> DataFrame:
        """queries (row, id, label, v, low, high) with `cells` that may hold a score in a window; same: only the first so many of the label are sought, which the sample bounds from below."""
        tree, paths, width, blocks = self.tree, self.paths, self.width, np.array(self.blocks)
        x, *texts = self.sample
        # Equal texts get equal numbers; what the sample doesn't have gets -1.
        known = [{t: i for i, t in enumerate(dict.fromkeys(col))} for col in texts]
        labels, ids = (np.array([k[t] for t in col], dtype=np.int64) for k, col in zip(known, texts, strict=True))

        def route(batches):
            for b in batches:
                q = _matrix(b.column(b.schema.names.index("v")), width)
                low, high = (_matrix(b.column(b.schema.names.index(c))) for c in ("low", "high"))
                if same and len(x) >= same and len(q):
                    label, own = (np.array([k.get(v, -1) for v in b.column(b.schema.names.index(c)).to_pylist()]) for k, c in zip(known, ("label", "own"), strict=True))
                    s = products(q, x)
                    s[(label[:, None] != labels[None, :]) | (own[:, None] == ids[None, :])] = NONE
                    low = np.maximum(low, np.partition(s, len(x) - same, axis=1)[:, len(x) - same][:, None])
                top, least = tree.scores(q, paths)
                live = ((top[:, None, :] >= low[:, :, None]) & (least[:, None, :] <= high[:, :, None]) & (low <= high)[:, :, None]).any(1) & (blocks > 0)[None, :]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.flatnonzero(r).astype(np.int32) for r in live], pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

        fed = queries.withColumn("own", F.col("id").cast("string"))  # as the sample has it, whatever the type of ids
        return fed.mapInArrow(route, fed.select("*", F.array(F.lit(0)).alias("cells")).schema).drop("own")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, window, rank, id, score): for each query and window the k nearest rows."""
        slices = max(-(-self.anchors // SLICE), 1)
        n_blocks = F.array(*[F.lit(n) for n in self.blocks])
        pieces = lambda cell: F.get(n_blocks, cell)
        rows = self.rows.withColumn("block", F.pmod(F.xxhash64("row"), F.greatest(pieces(F.col("cell")), F.lit(1))).cast("int")).select("cell", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "id", "label", "v")
        asked = self.routed(queries, k if same else 0).withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")).withColumn("cell", F.explode("cells"))
        asked = asked.select("cell", F.explode(F.sequence(F.lit(0), pieces(F.col("cell")) - 1)).alias("block"), "slice", "row", "id", "label", "v", "low", "high")
        most, width = self.most, self.width
        names = ["row", "window", "id", "score"]

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], left["id"].type), pa.array([], pa.int64())], names=names)
            left = left.take(pc.sort_indices(left["id"], null_placement="at_end"))
            label, q_label = _codes(left["label"], right["label"])
            own, q_own = _codes(left["id"], right["id"])
            low, high = _matrix(right["low"]), _matrix(right["high"])
            score, row = nearest(_matrix(left["v"], width), label, own, _matrix(right["v"], width), q_label, q_own, low, high, same, k, most)
            i, j, n = np.nonzero(score != NONE)
            return pa.table([pc.take(right["row"].combine_chunks(), i), pa.array(j, pa.int32()), pc.take(left["id"].combine_chunks(), row[i, j, n]), pa.array(score[i, j, n])], names=names)

        at = ["cell", "block", "slice"]
        schema = queries.select("row", F.lit(0).alias("window"), "id", F.lit(0).cast("long").alias("score")).schema
        found = rows.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(one, schema)
        rank = F.row_number().over(Window.partitionBy("row", "window").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    The rows of `anchor` are asked for their `positives` nearest rows of the same label; for each, the first `negatives` rows of
    other labels with a score from low to high per cent of the positive's follow. Components count as floor(scale * x).
    """
    index = Index(df, key, vector, label, scale, anchor)
    asked = index.rows.where("anchor").select("row", "id", "label", "v")
    whole = F.array(F.lit(NONE + 1)), F.array(F.lit(-NONE - 1))
    found = written(index.search(asked.withColumn("low", whole[0]).withColumn("high", whole[1]), positives, True).select("row", "rank", "id", "score"), "positives")
    p = F.col("score").cast("decimal(20,0)")
    window = F.struct("rank", F.col("id").alias("positive_id"), "score", F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high"))
    lists = found.groupBy("row").agg(F.array_sort(F.collect_list(window)).alias("w"))
    blank = F.struct(F.lit(0).alias("rank"), F.lit(None).cast(index.id_type).alias("positive_id"), F.lit(0).cast("long").alias("score"), F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    filled = F.concat("w", F.array_repeat(blank, F.lit(positives) - F.size("w")))  # every query has as many windows
    again = asked.join(lists, "row").select("row", "id", "label", "v", F.transform(filled, lambda x: x["low"]).alias("low"), F.transform(filled, lambda x: x["high"]).alias("high"))
    taken = index.search(again, negatives, False).select("row", (F.col("window") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    anchors = asked.select("row", F.col("id").alias("anchor_id"))
    return taken.join(pairs, ["row", "place"]).join(anchors, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_sql() -> str:
    """Every anchor against every row."""
    return """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
        p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same AND vec_id IS DISTINCT FROM anchor_id),
        n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.r, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank
              FROM p JOIN s USING (r, anchor_id) WHERE place <= 5 AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """
