"""Fill-in-the-middle: texts are cut at unit boundaries and put together again around sentinels.

A unit is a word with the blanks before it; blanks at the end of a text are a unit of their own. A table-driven
automaton reads the bytes of a text. Its states tell blanks, words, the bytes that a UTF-8 character still
needs, and how much of a sentinel has been seen; its transitions emit counts of unit starts, characters and
sentinels, packed into one number. Texts are read in blocks of bounded length that advance together, each
from the state that the bytes before it lead to; a block whose guess was wrong is read again, so the counts
are those of one scan. The sums of the blocks' counts say in which block a cut lies, and a second pass over
those blocks alone finds its byte.

The numbers that decide cuts and form come from the SHA-256 of seed and key, so a row has one result
whatever the partitioning. Every row is handled in place: no shuffle.

Defined results: a null text is the empty text, which has no units and the form plain; a null key hashes as the
empty string; repeated rows have equal results; an empty table has an empty result; other columns stay,
and the new ones take names that are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioflow.llm.common import free_name, small_batches, table

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of those that put the suffix first.
RATE, SPM = 50, 80
#: Bytes that one block holds, and how many bytes before it decide the state it starts in.
BLOCK, LOOK_BACK = 1024, 4

# States: nothing read, within blanks, within a word, after <, after < and a letter, and a word that needs 1 to 3 more bytes.
START, SPACES, WORD, OPEN, LETTER, MORE1, MORE2, MORE3 = range(8)
#: What a transition adds: unit starts, characters and sentinels in fields that a block cannot overflow.
UNIT, CHAR, SENTINEL = 1, 1 << 20, 1 << 40
FIELD = (1 << 20) - 1


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted count) for state * 256 + byte."""
    to = np.full((8, 256), WORD, dtype=np.int64)
    emit = np.full((8, 256), CHAR, dtype=np.int64)
    blank = [9, 10, 11, 12, 13, 32]
    to[:, blank] = SPACES
    to[:, ord("<")] = OPEN
    to[OPEN, [ord(mark[1]) for mark in (PREFIX, SUFFIX, MIDDLE)]] = LETTER
    emit[LETTER, ord(">")] += SENTINEL
    to[:, 0xC0:0xE0], to[:, 0xE0:0xF0], to[:, 0xF0:] = MORE1, MORE2, MORE3
    for state, rest in ((MORE3, MORE2), (MORE2, MORE1), (MORE1, WORD)):
        to[state, 0x80:0xC0] = rest
    emit[:, 0x80:0xC0] = 0  # a byte that goes on with a character
    emit[START] += UNIT
    for state in range(8):
        if state not in (START, SPACES):
            emit[state, blank] += UNIT  # blanks behind a word begin the next unit
    return to.ravel() * 256, emit.ravel()


_TO, _EMIT = automaton()


class Scan:
    """The blocks of a batch of texts and what the first pass counted in them."""

    def __init__(self, texts: list[bytes], block: int = BLOCK):
        self.raw = np.frombuffer(b"".join(texts) + b"\0", dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(size)])
        n = -(-size // block)
        self.first = np.concatenate([[0], np.cumsum(n)])  # first block of each text
        text = np.repeat(np.arange(len(texts)), n)
        self.start = self.offset[text] + (np.arange(len(text)) - self.first[text]) * block
        self.size = np.minimum(self.offset[text + 1] - self.start, block)
        heads = np.zeros(len(text), dtype=bool)
        heads[self.first[:-1][n > 0]] = True
        state = self._guess(heads, block)
        end, self.counts = self._read(np.arange(len(text)), state)
        while True:  # a block has to start where the one before it ended
            want = np.where(heads, START * 256, np.concatenate([[0], end[:-1]])) if len(end) else end
            wrong = np.flatnonzero(want != state)
            if not len(wrong):
                break
            state[wrong] = want[wrong]
            end[wrong], self.counts[wrong] = self._read(wrong, state[wrong])
        self.state = state
        self.sums = np.concatenate([[0], np.cumsum(self.counts & FIELD)])
        self.char_sums = np.concatenate([[0], np.cumsum(self.counts >> 20 & FIELD)])
        marks = np.concatenate([[0], np.cumsum(self.counts >> 40)])
        self.units = self.sums[self.first[1:]] - self.sums[self.first[:-1]]
        self.chars = self.char_sums[self.first[1:]] - self.char_sums[self.first[:-1]]
        self.marked = marks[self.first[1:]] > marks[self.first[:-1]]

    def _guess(self, heads: np.ndarray, block: int) -> np.ndarray:
        state = np.full(len(heads), START * 256, dtype=np.int64)
        back = min(LOOK_BACK, block)
        rest = np.flatnonzero(~heads)
        for k in range(back, 0, -1):
            state[rest] = _TO[state[rest] + self.raw[self.start[rest] - k]]
        return state

    def _read(self, blocks: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state at the end, counts) of some blocks; those that still have bytes advance together."""
        order = np.argsort(-self.size[blocks], kind="stable")
        at, size = self.start[blocks][order], self.size[blocks][order]
        now, counts = state[order].copy(), np.zeros(len(blocks), dtype=np.int64)
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        for k in range(longest):
            m = alive[k]
            step = now[:m] + self.raw[at[:m] + k]
            counts[:m] += _EMIT[step]
            now[:m] = _TO[step]
        end, total = np.empty_like(now), np.empty_like(counts)
        end[order], total[order] = now, counts
        return end, total

    def cuts(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, characters) before the given unit of each given text; a text's number of units means its end."""
        byte, chars = self.offset[text + 1] - self.offset[text], self.chars[text].copy()
        inner = np.flatnonzero(unit < self.units[text])
        if not len(inner):
            return byte, chars
        before = self.sums[self.first[text[inner]]] + unit[inner]  # unit starts of the batch before the one sought
        block = np.searchsorted(self.sums, before, side="right") - 1
        order = np.argsort(-self.size[block], kind="stable")
        inner, before, block = inner[order], before[order], block[order]
        at, size, now = self.start[block], self.size[block], self.state[block].copy()
        left = before - self.sums[block]
        seen = np.zeros(len(block), dtype=np.int64)
        alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        for k in range(int(size[0])):
            m = alive[k]
            step = now[:m] + self.raw[at[:m] + k]
            emitted = _EMIT[step]
            hit = np.flatnonzero((emitted & FIELD > 0) & (seen[:m] & FIELD == left[:m]))
            if len(hit):
                i = inner[hit]
                byte[i] = at[hit] + k - self.offset[text[i]]
                chars[i] = self.char_sums[block[hit]] - self.char_sums[self.first[text[i]]] + (seen[hit] >> 20 & FIELD)
            seen[:m] += emitted
            now[:m] = _TO[step]
        return byte, chars


def arranged(texts: list[bytes], numbers: np.ndarray, rate: int, spm: int, block: int = BLOCK) -> list[tuple]:
    """(units, form, characters of prefix and middle, output) of each text, given its four numbers."""
    scan = Scan(texts, block)
    n = scan.units
    a, b = numbers[:, 0] % (n + 1), numbers[:, 1] % (n + 1)
    plain = (n == 0) | scan.marked | (numbers[:, 2] % 100 >= rate)
    rows = np.flatnonzero(~plain)
    low, low_chars = scan.cuts(rows, np.minimum(a, b)[rows])
    high, high_chars = scan.cuts(rows, np.maximum(a, b)[rows])
    out: list[tuple] = [(int(n[i]), "plain", None, None, t) for i, t in enumerate(texts)]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for k, i in enumerate(rows.tolist()):
        t, x, y = texts[i], int(low[k]), int(high[k])
        first = numbers[i, 3] % 100 < spm
        parts = [s, t[y:], p, t[:x]] if first else [p, t[:x], s, t[y:]]
        out[i] = (int(n[i]), "spm" if first else "psm", int(low_chars[k]), int(high_chars[k] - low_chars[k]), b"".join([*parts, m, t[x:y]]))
    return out


def numbers_of(key: Column, seed: int = SEED) -> Column:
    """The first four groups of eight hex digits of the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, spm: int = SPM, seed: int = SEED) -> tuple[DataFrame, dict[str, str]]:
    """(df with n, form, prefix_chars, middle_chars and output, names of these columns in it). No shuffle."""
    kinds = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    names: dict[str, str] = {}
    for c in kinds:
        names[c] = free_name(df, c)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if x is None else x.encode() for x in batch.column(1).to_pylist()]
            numbers = np.array(batch.column(2).flatten(), dtype=np.int64).reshape(len(texts), 4)
            done = arranged(texts, numbers, rate, spm) if texts else []
            column = lambda k, kind: pa.array([r[k] for r in done], kind)
            made = [column(0, pa.int64()), column(1, pa.string()), column(2, pa.int64()), column(3, pa.int64()), column(4, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["row", *kinds])

    # The row travels as one struct, so none of its columns can clash with those read or made here.
    fed = df.select(F.struct("*").alias("row"), F.col(f"`{text}`").cast("string").alias("text"), numbers_of(F.col(f"`{key}`"), seed).alias("numbers"))
    schema = StructType([fed.schema["row"], *[StructField(c, LongType() if kind == "long" else StringType()) for c, kind in kinds.items()]])
    return fed.mapInArrow(run, schema).select("row.*", *[F.col(c).alias(names[c]) for c in kinds]), names


def restored(output: Column, form: Column) -> Column:
    """The text that transform() was given. Sentinels are found from the left: no text that holds one is ever cut."""
    after = lambda mark: F.locate(mark, output)
    piece = lambda a, b: F.substring(output, a, b - a)
    size, step = F.length(output) + 1, len(PREFIX)
    p, s, m = after(PREFIX), after(SUFFIX), after(MIDDLE)
    prefix = piece(p + step, F.when(form == "psm", s).otherwise(m))
    suffix = piece(s + step, F.when(form == "psm", m).otherwise(p))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, piece(m + step, size), suffix))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, c = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    output, form = F.col(c["output"]), F.col(c["form"])
    return done.select("doc_id", F.col(c["n"]).alias("n"), form.alias("form"), c["prefix_chars"], c["middle_chars"], digest(output).alias("output_sha256"), digest(restored(output, form)).alias("restored_sha256"))


def op13_sql() -> str:
    """Units as a list; the same numbers from the same digest."""
    h = [f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT)" for k in range(4)]
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM t),
        n AS (SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, {h[0]} % (len(units) + 1) AS x, {h[1]} % (len(units) + 1) AS y,
                CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {h[2]} % 100 >= {RATE} THEN 'plain'
                     WHEN {h[3]} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
        c AS (SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, least(x, y)), '') AS p,
                array_to_string(list_slice(units, least(x, y) + 1, greatest(x, y)), '') AS m, array_to_string(list_slice(units, greatest(x, y) + 1, n), '') AS s FROM n)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
          sha256(text) AS restored_sha256
        FROM c
    """
