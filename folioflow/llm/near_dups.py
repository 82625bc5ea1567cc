"""Near-duplicate documents by a signature-coordinate inverted join.

Every distinct shingle set gets a MinHash signature. Its coordinate-value pairs are tokens of an inverted
index. Two documents at the threshold agree on nearly all coordinates, so they share at least
least_matches() of them; hence they share one among the COORDINATES - least_matches() + 1 tokens that are rarest in the corpus
(prefix filter), and tokens nobody shares are skipped. Candidates whose signatures agree in that
many coordinates are confirmed on the full shingle sets.

All pairs of a group are never written. Documents with equal sets are one class. Within a token's list
every class is first compared with one hub, the class whose tokens are the commonest; the links give
components. What is apart from the hub's component is compared with a second hub, and what is then still
apart with whatever an exact prefix filter on the full sets leaves in other components. So no link that
joins two components is lost.

Defined results: a text without words (also a null one) has an empty set, is linked with nothing and is
its own component; fewer words than a shingle make one shingle of the whole sequence; rows with equal
ids are judged by their texts; a row with a null id belongs to the component of its text, whose id is the
smallest non-null one, or null; kept is true where doc_id equals component_id, nulls being equal. Further
columns, of any name, are ignored by near_dups and kept by first_rows, which leaves exactly one row of each
component: the one with the smallest id, nulls last, then with the smallest hash of its text; of equal rows,
one; rows without words all stay. An empty table has an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import drop_written, free_name, hot_keys, salted_left_join, small_batches, table, written
from folioflow.llm.wordhash import mix, runs, words_of

SHINGLE = 5
THRESHOLD = 85  # per cent; op9's contract
COORDINATES = 32
#: Probability with which two sets at the threshold may agree in fewer coordinates than asked for.
MISSED = 6e-7
#: Sets of a few hundred shingles are told apart; longer ones are left to the confirmation.
PARITY_BITS = 512
#: Prefixes that one shingle may stand in before it takes two shingles to meet.
COMMON = 1_000
_SEEDS = np.random.default_rng(8675309).integers(1, 1 << 63, size=(2, COORDINATES), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    w = words_of([(t or "").encode("utf-8", "surrogatepass") for t in texts], fold=True)
    full = runs(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif b > a:
            out.append(mix(runs(w.hash[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, set_key, tokens, row_hash): tokens are the coordinate-value pairs as numbers, row_hash is of the text as it stands."""
    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.StringType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("row_hash", T.LongType())])

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            size = np.array([len(s) for s in sets], dtype=np.int64)
            some = np.flatnonzero(size)
            flat = np.concatenate([sets[i] for i in some]) if len(some) else np.zeros(0, dtype=np.uint64)
            begin = np.concatenate([[0], np.cumsum(size[some])])[:-1]
            tokens = np.zeros((len(some), COORDINATES), dtype=np.uint64)
            if len(some):
                for k in range(COORDINATES):
                    tokens[:, k] = mix(np.minimum.reduceat((flat ^ _SEEDS[0, k]) * _SEEDS[1, k], begin) ^ _SEEDS[1, k])
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, COORDINATES, 0))]).astype(np.int32)
            keys = [hashlib.md5(s.tobytes()).hexdigest() if len(s) else None for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(keys, type=pa.string()), lists, batch.column(2)], names=["key", "n_shingles", "set_key", "tokens", "row_hash"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("row_hash")).mapInArrow(run, schema)


def least_matches(threshold: int) -> int:
    """Coordinates in which two sets at the threshold (per cent) agree but for a probability of MISSED: 16 at 85, 13 at 80."""
    j, below = threshold / 100, 0.0
    for m in range(COORDINATES):
        below += comb(COORDINATES, m) * j**m * (1 - j) ** (COORDINATES - m)
        if below > MISSED:
            return m
    return COORDINATES


def postings(classes: DataFrame, threshold: int) -> DataFrame:
    """(token, id, n, weight) of the prefix tokens that at least two classes hold; classes have id, n, tokens.

    weight is how often the class's tokens occur: in a group of copies it is greatest near the middle.
    """
    each = classes.select("id", "n", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("cnt")).where("cnt > 1")
    held = each.join(shared, "token")
    prefix = COORDINATES - least_matches(threshold) + 1
    ranked = held.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("cnt", "token"))).alias("t"), F.sum("cnt").alias("weight"))  # at most COORDINATES
    room = F.lit(prefix - COORDINATES) + F.size("t")
    return ranked.where(room > 0).select("id", "n", "weight", F.explode(F.slice("t", F.lit(1), room)).alias("t")).select("t.token", "id", "n", "weight")


def _sized(a: str, b: str, threshold: int):
    """Sets of such sizes can reach the threshold."""
    return (F.col(a) * threshold <= F.col(b) * 100) & (F.col(b) * threshold <= F.col(a) * 100)


def candidates(posts: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, tokens, text) of the classes that share a prefix token: the text of the class's first row; the only time whole texts are dealt out."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias("name")
    wanted = posts.select("id").distinct().join(classes.select("id", name("label.key"), "label.row_hash", "tokens"), "id")
    named = docs.select(name("key"), F.xxhash64("text").alias("row_hash"), "text")
    return written(named.join(wanted, ["name", "row_hash"]).select("id", "tokens", "text").dropDuplicates(["id"]), "near-dup-candidates")


def _attach(pairs: DataFrame, cands: DataFrame, column: str, side: str, other: str, hot: list) -> DataFrame:
    """The column of one side's class."""
    return salted_left_join(pairs, cands.select(F.col("id").alias(side), F.col(column).alias(f"{column}_{side}")), side, F.col(other), hot)


def confirmed(pairs: DataFrame, cands: DataFrame, threshold: int, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The pairs (a, b) that agree in enough coordinates and whose full shingle sets reach the threshold."""
    pairs = written(pairs, "near-dup-pairs", done)
    n = pairs.count()
    if not n:
        drop_written(pairs)
        return pairs.sparkSession.createDataFrame([], "a long, b long")
    hot = {side: hot_keys(pairs, side, rows=n) for side in "ab"}
    both = _attach(_attach(pairs, cands, "tokens", "a", "b", hot["a"]), cands, "tokens", "b", "a", hot["b"])
    same = F.size(F.filter(F.zip_with("tokens_a", "tokens_b", lambda x, y: x == y), lambda x: x))
    agreeing = written(both.where(same >= least_matches(threshold)).select("a", "b"), "near-dup-agreeing", (pairs,))
    used = cands.join(agreeing.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    texts = _attach(_attach(agreeing, used, "text", "a", "b", hot["a"]), used, "text", "b", "a", hot["b"])

    def run(batches):
        for batch in batches:
            a, b = shingle_sets(batch.column(2).to_pylist()), shingle_sets(batch.column(3).to_pylist())
            keep = []
            for x, y in zip(a, b, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return written(texts.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "near-dup-links", (agreeing,))


def starred(posts: DataFrame, threshold: int, rows: int) -> DataFrame:
    """(a, b): in each token's list the heaviest class against the others; posts have token, id, n, weight, and no more than `rows` rows."""
    hubs = posts.groupBy("token").agg(F.max_by(F.struct(F.col("id").alias("a"), F.col("n").alias("an")), F.struct("weight", -F.col("id"))).alias("h")).select("token", "h.a", "h.an")
    met = salted_left_join(posts, hubs, "token", F.col("id"), rows=rows).where((F.col("id") != F.col("a")) & _sized("n", "an", threshold))
    return met.select("a", F.col("id").alias("b")).distinct()


def parities(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(sets x words of 64 bits): whether an odd number of the set's shingles fall on each of PARITY_BITS places."""
    owner = np.repeat(np.arange(len(size)), size)
    place = (flat >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(owner * PARITY_BITS + place, minlength=len(size) * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(size), PARITY_BITS // 64)


def prefix_pairs(open_: DataFrame, cands: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, a table to delete behind them): pairs are (a, b) of different components that share a shingle early enough, in a common order by rarity, to reach the threshold.

    open_ has id, comp, n. The prefix filter on the full sets is exact, and sharp: a copy with more edits of
    its own than the threshold allows has only rare shingles in its prefix and meets nobody. Of those that
    meet, the parities of their sets tell most that differ in too many shingles: two sets differ in at least
    as many shingles as their parities differ in bits, so this too is exact.
    """

    words = [f"bits{k}" for k in range(PARITY_BITS // 64)]

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(3).to_pylist())
            size = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.view(np.int64)))
            bits = parities(flat, size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists, *[pa.array(bits[:, k]) for k in range(len(words))]], names=["id", "comp", "n", "set", *words])

    schema = "id long, comp long, n long, set array<long>, " + ", ".join(f"{c} long" for c in words)
    texts = cands.select("id", "text").join(open_, "id").select("id", "comp", "n", "text")
    sets = written(texts.mapInArrow(run, schema), "near-dup-sets")
    each = sets.select("id", F.explode("set").alias("shingle"))
    df = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(df, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s")).join(sets.drop("set"), "id")
    rare = F.col("n") - F.size("s")  # shingles nobody else has stand before those in s
    room = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1 - rare
    # One place more than the prefix: sets at the threshold share one shingle within the prefix, and two within one place more.
    longer = F.slice("s", F.lit(1), (room + 1).cast("int"))
    posts = ranked.where(room > 0).select("id", "comp", "n", *words, rare.alias("rare"), F.posexplode(longer).alias("k", "s"))
    posts = written(posts.select("s.shingle", "id", "comp", "n", *words, (F.col("k") + F.col("rare")).alias("pos")), "near-dup-prefixes", (sets,))
    common = posts.groupBy("shingle").agg(F.count("*").alias("cnt")).where(F.col("cnt") > COMMON).select("shingle")
    common = written(common, "near-dup-common")
    if common.isEmpty():
        return met_pairs(posts, "shingle", threshold, words, 0), posts
    # A shingle that very many prefixes hold pairs nobody by itself: two sets share a further one, which is rarer or as common.
    held = posts.join(common, "shingle")
    lists = held.groupBy("id", "comp", "n", *words).agg(F.array_sort(F.collect_list(F.struct("pos", "shingle"))).alias("c"))
    twos = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(F.xxhash64(x["shingle"], y["shingle"]).alias("two"), y["pos"].alias("pos")))))
    both = lists.select("id", "comp", "n", *words, F.explode(twos).alias("t")).select("t.two", "id", "comp", "n", *words, "t.pos")
    alone = met_pairs(posts.join(common, "shingle", "left_anti"), "shingle", threshold, words, 1)
    return alone.unionByName(met_pairs(both, "two", threshold, words, 1)).distinct(), posts


def met_pairs(posts: DataFrame, key: str, threshold: int, words: list[str], beyond: int) -> DataFrame:
    """(a, b) of different components that share a key within the prefix of the pair, or `beyond` places behind it, and whose parities may reach the threshold."""
    x, y = (posts.select(key, *[F.col(c).alias(f"{c}_{side}") for c in ("id", "comp", "n", "pos", *words)]) for side in "ab")
    need = F.ceil((F.col("n_a") + F.col("n_b")) * threshold / (100 + threshold))
    near = (F.col("pos_a") <= F.col("n_a") - need + beyond) & (F.col("pos_b") <= F.col("n_b") - need + beyond)
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in words), F.lit(0))
    alike = differ <= F.col("n_a") + F.col("n_b") - 2 * need
    met = x.join(y, key).where((F.col("comp_a") != F.col("comp_b")) & (F.col("id_a") < F.col("id_b")) & _sized("n_a", "n_b", threshold) & near & alike)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each linked id reaches. Labels spread and then jump, so rounds grow with the log of a path."""
    both = written(edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v").distinct(), "near-dup-edges")
    n = both.count()
    if not n:
        drop_written(both)
        return both.sparkSession.createDataFrame([], "id long, comp long")
    labels = both.groupBy("u").agg(F.least("u", F.min("v")).alias("comp"))
    labels = written(labels, "near-dup-labels")
    hot = hot_keys(both, "v", rows=n)
    while True:
        near = salted_left_join(both, labels.select(F.col("u").alias("v"), "comp"), "v", F.col("u"), hot).groupBy("u").agg(F.min("comp").alias("near"))
        spread = labels.join(near, "u").select("u", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jumped = salted_left_join(spread, labels.select(F.col("u").alias("to"), F.col("comp").alias("far")), "to", F.col("u"), rows=n)
        new = written(jumped.select("u", F.least("to", F.coalesce("far", "to")).alias("comp"), "was"), "near-dup-labels", (labels,))
        changed = new.where("comp <> was").limit(1).count()
        labels = new.select("u", "comp")
        if not changed:
            drop_written(both)
            return labels.withColumnRenamed("u", "id")


def link(classes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """(id, comp) of the classes that are linked with another one."""
    posts = written(postings(classes, threshold), "near-dup-postings")
    n = posts.count()
    cands = candidates(posts, classes, docs)
    links = [confirmed(starred(posts, threshold, n), cands, threshold)]
    comps = components(links[0])

    def more(found: DataFrame) -> None:
        """Takes further links in, if there are any."""
        nonlocal comps
        if not found.isEmpty():
            links.append(found)
            comps, old = components(reduce(DataFrame.unionByName, links)), comps
            drop_written(old)

    def placed() -> DataFrame:
        """Lists that still hold several components."""
        at = posts.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        main = at.groupBy("token").agg(F.max_by("comp", F.struct("weight", -F.col("id"))).alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        return at.join(main.where("lo <> hi").select("token", "main"), "token")

    # What is apart from the first hub is compared with a second one.
    more(confirmed(starred(placed().where("comp <> main").select("token", "id", "n", "weight"), threshold, n), cands, threshold))
    # What is still apart, across components.
    open_ = written(placed().select("id", "comp", "n").distinct(), "near-dup-open", (posts,))
    pairs, prefixes = prefix_pairs(open_, cands, threshold)
    more(confirmed(pairs, cands, threshold, (prefixes, open_)))
    drop_written(*links, cands)
    return comps


def judged(df: DataFrame, key: str, text: str, threshold: int) -> DataFrame:
    """(key, row_hash, n_shingles, label), one row per row of df: label is the first row (no_key, key, row_hash) of the component, null without words."""
    sigs = written(signatures(df, key, text), "near-dup-signatures")
    label = F.struct(F.col("key").isNull().alias("no_key"), "key", "row_hash")
    classes = sigs.where("n_shingles > 0").groupBy("set_key").agg(F.min(label).alias("label"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "near-dup-classes")
    n_classes = classes.count()
    comps = link(classes, df.select(F.col(key).alias("key"), F.col(text).alias("text")), threshold)
    named = classes.select("id", "set_key", "label").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    smallest = named.groupBy("comp").agg(F.min("label").alias("label"))
    by_set = written(salted_left_join(named.drop("label"), smallest, "comp", F.col("id"), rows=n_classes).select("set_key", "label"), "near-dup-labelled", (comps, classes))
    some, none = sigs.where("n_shingles > 0"), sigs.where("n_shingles = 0")
    columns = ["key", "row_hash", "n_shingles"]
    met = salted_left_join(some.select(*columns, "set_key"), by_set, "set_key", F.xxhash64("key", "row_hash"), rows=sigs.count())
    return met.select(*columns, "label").unionByName(none.select(*columns, F.lit(None).cast(by_set.schema["label"].dataType).alias("label")))


def near_dups(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row per row of df; threshold: per cent of Jaccard similarity from which two are linked."""
    out = judged(df, key, text, threshold).withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("label.key")).otherwise(F.col("key")))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def first_rows(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of df that are the first of their component, or have no words."""
    seen = written(judged(df, key, text, threshold), "near-dup-judged")
    first = F.col("key").eqNullSafe(F.col("label.key")) & (F.col("row_hash") == F.col("label.row_hash"))
    name = free_name(df, "_row_hash")
    rows = df.withColumn(name, F.xxhash64(text))
    gone = seen.where((F.col("n_shingles") > 0) & ~first)
    out = rows.join(gone, rows[key].eqNullSafe(gone["key"]) & (rows[name] == gone["row_hash"]), "left_anti")
    if seen.where((F.col("n_shingles") > 0) & first).groupBy("key", "row_hash").count().where("count > 1").limit(1).count():
        has_words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        out = out.where(has_words).dropDuplicates([key, name]).unionByName(out.where(~has_words))
    return out.drop(name)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"), threshold=THRESHOLD)
