"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A text is parsed against
it greedily: the longest match from the current place is a phrase, then the next phrase begins. Texts of
the same language have long matches, so few phrases; phrases are normalised by the text's length, and
the language that needs the fewest wins.

The automata are built once on the driver from the sample and sent to the workers as transition tables
(rows: states, columns: the commonest symbols of the samples, as many as TABLE_BYTES hold for all
languages together; transitions by rarer ones are a sorted list). Every letter of the samples is a symbol.
Parsing is vectorised: texts are cut into blocks, the blocks of a batch advance together, one character a
step, and the phrases of the blocks add up. Cutting adds at most one phrase a block, to every language
alike; no part of a text is left out.

Languages come in blocks of LANGUAGES, in their order: with more of them, the texts are parsed against one block
after the other, and the two lowest counts are carried on in a written table. A language's count doesn't depend on
the others, so the results are those of one block of all.

Defined results: null texts and texts without a letter get "und" and score 0; equal texts get equal
results; ties go to the language that sorts first; without any labelled row everything is "und"; an empty table
has an empty result; columns of the input stay, but those that have the names of the two results are replaced
(pass other names for these).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import free_name, held_out, small_batches, table, written

#: The sample: characters for each language, in whole rows, of at most so many labelled rows of at most so many characters.
SAMPLE_CHARS, SAMPLE_ROWS, ROW_CHARS = 24_000, 200, 1_200
#: Rows shorter than this show little of a language and come last.
SHORT = 60
#: Rows of a language that are ranked, as many times SAMPLE_ROWS, however many there are.
RANKED = 20
#: Languages of a block: with a sample each, what goes to every task stays under 300 MB.
LANGUAGES = 256
#: Bound of the dense part of the transition table, and most symbols that have a column.
TABLE_BYTES, ALPHABET = 1 << 27, 64
BLOCK = 1024
#: Letters are compared in lower case. What is neither letter nor space is left out; a letter that no sample has is UNSEEN.
OTHER, SPACE, UNSEEN = 0, 1, 2


@dataclass
class Languages:
    names: list[str]
    symbol_of: np.ndarray  # code point -> symbol
    columns: int  # symbols that have a column
    step: np.ndarray  # (all states of all languages) * columns + symbol -> state, or -1
    root: np.ndarray  # first state of each language
    width: int  # symbols in all
    rare: np.ndarray  # sorted state * width + symbol of the transitions by symbols from `columns` on
    rare_to: np.ndarray  # and the states they lead to
    more: Callable[[], Languages | None] | None = None  # learns the next block of languages

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """(languages x places) next states, or -1; symbol has one entry a place."""
        out = self.step[state * np.int64(self.columns) + np.where(symbol < self.columns, symbol, OTHER)]
        if len(self.rare) and len(at := np.flatnonzero(symbol >= self.columns)):
            key = state[:, at].astype(np.int64) * self.width + symbol[at]
            k = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            out[:, at] = np.where(self.rare[k] == key, self.rare_to[k], -1)
        return out


def automaton_moves(symbols: list[int]) -> list[dict[int, int]]:
    """For each state of the automaton that accepts the substrings of `symbols`, symbol -> next state."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


def dense(moves: list[dict[int, int]], width: int) -> np.ndarray:
    """Transition table of the symbols below width; -1 where there is none."""
    table_ = np.full((len(moves), width), -1, dtype=np.int32)
    for s, m in enumerate(moves):
        for c, t in m.items():
            if c < width:
                table_[s, c] = t
    return table_


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transition table of the automaton that accepts the substrings of `symbols`."""
    return dense(automaton_moves(symbols), width)


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", after: str | None = None) -> tuple[dict[str, str], str | None]:
    """(lang -> joined whole rows, SAMPLE_CHARS characters at most; the last language of the block if there are more): a hash of `order` spreads the rows over the table.

    The block begins with the first language behind `after`. Counting the rows of each language first leaves about
    RANKED * SAMPLE_ROWS of them to be ranked.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(order), F.col(text)).alias("h"), F.col(text).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    if after is not None:
        rows = rows.where(F.col("lang") > after)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()
    last = None
    if len(counts) > LANGUAGES:
        counts, last = counts[:LANGUAGES], counts[LANGUAGES - 1]["lang"]
        rows = rows.where(F.col("lang") <= last)
    share = {r["lang"]: min(1.0, RANKED * SAMPLE_ROWS / r["n"]) for r in counts}
    fewer = {k: v for k, v in share.items() if v < 1}
    if fewer:
        bar = F.create_map(*[F.lit(x) for k, v in fewer.items() for x in (k, int(v * (1 << 62)))])
        rows = rows.where(F.shiftrightunsigned("h", 2) < F.coalesce(bar[F.col("lang")], F.lit(1 << 62)))
    fits = rows.withColumn("t", F.lower(F.regexp_replace("t", r"\s+", " "))).withColumn("n", F.length("t")).where(F.col("t").rlike(r"\p{L}"))
    late = F.when(F.col("n") > ROW_CHARS, 2).when(F.col("n") < SHORT, 1).otherwise(0)
    # Of a row that is longer than a whole sample, and is taken only if its language has no other, the middle is the sample.
    most = F.when(F.col("n") > SAMPLE_CHARS, F.substring("t", ((F.col("n") - SAMPLE_CHARS) / 2).cast("int") + 1, F.lit(SAMPLE_CHARS))).otherwise(F.col("t"))
    w = Window.partitionBy("lang").orderBy("late", "h", "n")
    ranked = fits.select("lang", "h", "n", late.alias("late"), most.alias("t")).withColumn("r", F.row_number().over(w))
    got = ranked.where((F.col("r") <= SAMPLE_ROWS) & ((F.col("late") < 2) | (F.col("r") == 1))).orderBy("lang", "r").select("lang", "t").collect()
    out: dict[str, str] = {}
    for r in got:
        if len(out.get(r["lang"], "")) + len(r["t"]) <= SAMPLE_CHARS:
            out[r["lang"]] = (out.get(r["lang"], "") + " " + r["t"]).lstrip()
    return out, last


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", after: str | None = None) -> Languages | None:
    """Learns the first block of languages (behind `after`) from a bounded sample of the rows with a language; None without any."""
    texts, last = sample(labelled, text, lang, order, after)
    more = None if last is None else lambda: fit(labelled, text, lang, order, last)
    if not texts:
        return more() if more else None
    names = sorted(texts)
    letters = Counter(c for t in texts.values() for c in t if c.isalpha())
    symbol_of = np.array([UNSEEN if chr(k).isalpha() else OTHER for k in range(0x110000)], dtype=np.int32)
    symbol_of[[9, 10, 11, 12, 13, 32]] = SPACE
    for k, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0])), UNSEEN + 1):
        symbol_of[ord(c)] = k
        if len(c.upper()) == 1:
            symbol_of[ord(c.upper())] = k
    width = UNSEEN + 1 + len(letters)
    moves: list[dict[int, int]] = []
    root = []
    for name in names:
        sym = symbol_of[np.frombuffer(texts[name].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        sym = sym[(sym != OTHER) & ~((sym == SPACE) & np.concatenate([[False], sym[:-1] == SPACE]))]
        base = len(moves)
        root.append(base)
        moves += [{c: t + base for c, t in m.items()} for m in automaton_moves(sym.tolist())]
    columns = max(UNSEEN + 1, min(ALPHABET, TABLE_BYTES // (4 * len(moves))))
    rare = np.array(sorted((s * width + c, t) for s, m in enumerate(moves) for c, t in m.items() if c >= columns), dtype=np.int64).reshape(-1, 2)
    return Languages(names, symbol_of, columns, dense(moves, columns).ravel(), np.array(root, dtype=np.int32), width, rare[:, 0].copy(), rare[:, 1].astype(np.int32), more)


def phrases(model: Languages, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) number of phrases, and the number of symbols of each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    sym = model.symbol_of[points]
    keep = sym != OTHER
    sym, owner = sym[keep].astype(np.int32), owner[keep]
    size = np.bincount(owner, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    n_blocks = -(-size // BLOCK)
    block_owner = np.repeat(np.arange(len(texts)), n_blocks)
    nth = np.arange(len(block_owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    at = begin[block_owner] + nth * BLOCK
    length = np.minimum(size[block_owner] - nth * BLOCK, BLOCK)
    order = np.argsort(-length, kind="stable")  # the blocks that go on stand in front
    at, length, block_owner = at[order], length[order], block_owner[order]
    k = len(model.names)
    count = np.zeros((k, len(at)), dtype=np.int32)
    state = np.repeat(model.root[:, None], len(at), axis=1)
    alive = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
    for i in range(int(length[0]) if len(length) else 0):
        m = alive[i]
        c = sym[at[:m] + i]
        nxt = model.move(state[:, :m], c)
        ended = nxt < 0
        again = model.move(np.repeat(model.root[:, None], m, axis=1), c)
        count[:, :m] += ended
        np.copyto(nxt, np.where(again < 0, model.root[:, None], again), where=ended)
        state[:, :m] = nxt
    total = np.zeros((len(texts), k), dtype=np.int64)
    np.add.at(total, block_owner, count.T + 1)
    return total, size


#: More phrases than any text has: no language.
NONE = 1 << 62


def _parsed(df: DataFrame, model: Languages | None, text: str, names: list[str]) -> DataFrame:
    """df with names: language, score, least and second least number of phrases; where df has them, of an earlier block, the block's own are merged in."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(replace(model, more=None) if model else None)
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, t) for c, t in zip(names, (T.StringType(), T.DoubleType(), T.LongType(), T.LongType()), strict=True)])
    place, carried = keep.index(text), len(keep) < len(df.columns)

    def run(batches):
        m = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
            found, least, second = ["und"] * len(texts), np.full(len(texts), NONE), np.full(len(texts), NONE)
            if carried:
                found, least, second = batch.column(len(keep)).to_pylist(), *(np.array(batch.column(len(keep) + k), dtype=np.int64) for k in (2, 3))
            size = np.zeros(len(texts), dtype=np.int64)
            if m is not None and texts:
                total, size = phrases(m, texts)
                best = total.argmin(axis=1)
                two = np.sort(np.concatenate([total, np.full((len(texts), 1), NONE)], axis=1), axis=1)[:, :2]
                better = two[:, 0] < least
                found = [m.names[b] if x and y else f for b, x, y, f in zip(best.tolist(), better.tolist(), lettered.tolist(), found, strict=True)]
                second = np.where(better, np.minimum(least, two[:, 1]), np.minimum(second, two[:, 0]))
                least = np.minimum(least, two[:, 0])
            lead = np.where(second == NONE, 1.0, 1 - least / np.maximum(second, 1))
            score = np.where(lettered & (size > 0), lead, 0.0)
            made = [pa.array(found, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(least), pa.array(second)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=schema.names)

    return df.select(*keep, *(names if carried else [])).mapInArrow(run, schema)


def identify(df: DataFrame, model: Languages | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language (pred) and one minus the winner's phrases over the runner-up's (score)."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c.lower() not in (pred.lower(), score.lower())]
    names = [pred, score, free_name(df, "_least"), free_name(df, "_second")]
    out = _parsed(df.select(*keep), model, text, names)
    done: tuple[DataFrame, ...] = ()
    while model is not None and model.more is not None:
        model = model.more()
        if model is not None:
            cut = written(out, "languages", done)
            out, done = _parsed(cut, model, text, names), (cut,)
    return out.select(*keep, pred, score)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
