"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts becomes words (a run of word marks and what follows; no piece of the model crosses
that border, which is checked when the model is read). The distinct words lie end to end in one numpy
array of symbols. A round looks up the rank of every adjacent pair, takes the minimum of each word,
merges its leftmost pairs of that rank at once and compacts the array. Words without a mergeable pair
leave the array; the rounds end when it is empty.

Merging several occurrences at once equals one merge at a time as long as no merge makes a pair that
ranks as high; the occurrences behind such a merge wait for the next round.

Defined results: a null text is encoded as the empty text, which has no ids; the ids of a null or empty
list decode to the empty text; repeated rows have equal results; an empty table has an empty result; all columns of the
input stay as they are, and results that would have the name of one, in any case, get underscores behind theirs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import free_name, small_batches

MARK = "▁"
NONE = np.int64(1 << 40)
SHIFT = 21
#: A worker forgets its words when it holds this many words or ids.
CACHE_WORDS, CACHE_IDS = 250_000, 6_000_000


@dataclass
class PieceModel:
    """Arrays of one model; a few MB, whatever the input."""

    symbol_of: np.ndarray  # code point -> symbol, -1 if no piece holds the character
    pair_key: np.ndarray  # sorted left << SHIFT | right
    pair_rank: np.ndarray
    pair_symbol: np.ndarray
    id_of: np.ndarray  # symbol -> id, -1 if the symbol is no piece
    byte_id: np.ndarray  # byte -> id
    piece_bytes: np.ndarray  # what the ids decode to, end to end
    piece_at: np.ndarray
    bare: np.ndarray  # ids of bytes and of the unknown piece: a leading space of theirs stays
    dummy_prefix: bool = True


def load_model(path: str) -> PieceModel:
    """Read a BPE model with byte fallback and identity normalisation; other models are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback, identity normalisation and kept white space are supported")
    normal, byte = 1, 6
    names = {p.piece: i for i, p in enumerate(model.pieces) if p.type == normal}
    if any(MARK in x.lstrip(MARK) for x in names):
        raise ValueError("a piece of the model crosses words")
    if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
        raise ValueError("user-defined pieces are not supported")
    symbols = dict(names)
    for x in names:
        for c in x:
            symbols.setdefault(c, len(model.pieces) + len(symbols))
    order = {s: k for k, s in enumerate(sorted({p.score for p in model.pieces if p.type == normal}, reverse=True))}
    pairs = {}
    for x, i in names.items():
        for k in range(1, len(x)):
            if x[:k] in symbols and x[k:] in symbols:
                pairs[symbols[x[:k]] << SHIFT | symbols[x[k:]]] = (order[model.pieces[i].score], i)
    keys = np.array(sorted(pairs), dtype=np.int64)
    id_of = np.full(max(symbols.values()) + 1, -1, dtype=np.int32)
    id_of[list(names.values())] = list(names.values())
    symbol_of = np.full(0x110000, -1, dtype=np.int32)
    for x, s in symbols.items():
        if len(x) == 1:
            symbol_of[ord(x)] = s
    byte_id = np.zeros(256, dtype=np.int32)
    decoded, bare = [], np.zeros(len(model.pieces), dtype=bool)
    for i, p in enumerate(model.pieces):
        if p.type == byte:
            b = int(p.piece[3:5], 16)
            byte_id[b], bare[i] = i, True
            decoded.append(bytes([b]))
        elif p.type == 3:
            decoded.append(b"")
        elif p.type == 2:
            bare[i] = True
            decoded.append(train.unk_surface.encode())
        else:
            decoded.append(p.piece.replace(MARK, " ").encode())
    return PieceModel(
        symbol_of, keys, np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int64), np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int32),
        id_of, byte_id, np.frombuffer(b"".join(decoded), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in decoded])]).astype(np.int64), bare, norm.add_dummy_prefix,
    )


def _look_up(model: PieceModel, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank (NONE if the pair makes no piece) and symbol of each pair."""
    key = left.astype(np.int64) << SHIFT | right
    at = np.minimum(np.searchsorted(model.pair_key, key), len(model.pair_key) - 1)
    hit = (model.pair_key[at] == key) & (left >= 0) & (right >= 0)
    return np.where(hit, model.pair_rank[at], NONE), model.pair_symbol[at]


def merge_rounds(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words end to end, and the n + 1 offsets of the words in them."""
    n = len(words)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(n), np.fromiter(map(len, words), dtype=np.int64, count=n))
    sym, first = model.symbol_of[points], np.arange(len(points))
    rank, made = np.full(len(sym), NONE), np.zeros(len(sym), dtype=np.int32)
    if len(sym) > 1:
        rank[:-1], made[:-1] = _look_up(model, sym[:-1], sym[1:])
        rank[:-1][owner[:-1] != owner[1:]] = NONE
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
        live = least < NONE
        if not live.all():
            done.append((owner[~live], sym[~live], first[~live]))
            owner, sym, first, rank, made, least = (x[live] for x in (owner, sym, first, rank, made, least))
            if not len(sym):
                break
        # Of a run of overlapping occurrences, every second one from its left end.
        idx = np.flatnonzero(rank == least)
        new_run = np.concatenate([[True], np.diff(idx) > 1])
        in_run = np.arange(len(idx)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
        idx = idx[in_run % 2 == 0]
        new, worst, mine = made[idx], least[idx], owner[idx]
        side, side_owner = np.concatenate([[-1], sym, [-1, -1]]), np.concatenate([[-1], owner, [-1, -1]])
        joined = np.concatenate([[False], (np.diff(idx) == 2) & (mine[1:] == mine[:-1])])  # what stands on its left is merged too
        left = np.where(side_owner[idx] == mine, side[idx], -1)
        left = np.where(joined, np.concatenate([[-1], new[:-1]]), left)
        right = np.where(side_owner[idx + 3] == mine, side[idx + 3], -1)
        left_rank, left_made = _look_up(model, left, new)
        right_rank, right_made = _look_up(model, new, right)
        wait = (left_rank <= worst) | (right_rank <= worst)
        stops = np.cumsum(wait) - wait
        head = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        keep = stops == np.repeat(stops[head], np.diff(np.append(head, len(idx))))
        idx, new, joined, left_rank, left_made, right_rank, right_made = (x[keep] for x in (idx, new, joined, left_rank, left_made, right_rank, right_made))
        sym[idx], rank[idx], made[idx] = new, right_rank, right_made
        at = np.where(joined, idx - 2, idx - 1)
        inner = at >= 0
        rank[at[inner]], made[at[inner]] = left_rank[inner], left_made[inner]
        stay = np.ones(len(sym), dtype=bool)
        stay[idx + 1] = False
        owner, sym, first, rank, made = (x[stay] for x in (owner, sym, first, rank, made))
    if not done:
        return np.zeros(0, dtype=np.int32), np.zeros(n + 1, dtype=np.int64)
    owner, sym, first = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(owner, kind="stable")
    owner, sym, first = owner[order], sym[order], first[order]
    ids = np.where(sym >= 0, model.id_of[sym], -1)
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[first[unknown]].tolist()]
        count = np.ones(len(ids), dtype=np.int64)
        count[unknown] = [len(x) for x in raw]
        ids = np.repeat(ids, count)
        owner = np.repeat(owner, count)
        ids[ids < 0] = model.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def take_ragged(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices values[at : at + size] end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(at - (ends - size), size)]


@dataclass
class Codec:
    """Encodes and decodes lists of texts; keeps the ids of words it has met."""

    model: PieceModel
    seen: dict[str, int] = field(default_factory=dict)
    ids: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, dtype=np.int32))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1 << 12, dtype=np.int64))

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, " ")
        out = [MARK + x for x in text.split(" ")]
        if not self.model.dummy_prefix:
            out[0] = out[0][1:]
        if MARK in out or not out[0]:  # runs of spaces go with the word behind them
            joined, held = [], ""
            for x in out:
                if x in (MARK, ""):
                    held += x
                else:
                    joined.append(held + x)
                    held = ""
            out = joined + [held] * bool(held)
        return out

    def _learn(self, words: list[str]) -> None:
        if len(self.seen) + len(words) > CACHE_WORDS or self.at[len(self.seen)] > CACHE_IDS:
            self.seen.clear()
        n = len(self.seen)
        ids, at = merge_rounds(self.model, words)
        begin = int(self.at[n]) if n else 0
        while len(self.ids) < begin + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.at) <= n + len(words):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[begin : begin + len(ids)] = ids
        self.at[n : n + len(words) + 1] = begin + at
        self.seen.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and the offsets of the texts in them."""
        split = [self.words(t) for t in texts]
        flat = [w for ws in split for w in ws]
        fresh = list({w for w in flat if w not in self.seen})
        if fresh:
            before = len(self.seen)
            self._learn(fresh)
            if len(self.seen) < before + len(fresh):  # it began anew
                again = list({w for w in flat if w not in self.seen})
                if again:
                    self._learn_more(again)
        get = self.seen.__getitem__
        code = np.fromiter(map(get, flat), dtype=np.int64, count=len(flat))
        size = self.at[code + 1] - self.at[code]
        ids = take_ragged(self.ids, self.at[code], size)
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, ends

    def _learn_more(self, words: list[str]) -> None:
        """Beyond the bound of the cache: what one batch of texts holds must be there at once."""
        n, begin = len(self.seen), int(self.at[len(self.seen)])
        ids, at = merge_rounds(self.model, words)
        self.ids = np.concatenate([self.ids[:begin], ids, np.zeros(1 << 16, dtype=np.int32)])
        self.at = np.concatenate([self.at[: n + 1], begin + at[1:], np.zeros(1 << 12, dtype=np.int64)])
        self.seen.update(zip(words, range(n, n + len(words)), strict=True))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; bytes that are no UTF-8 become U+FFFD, each on its own."""
        m = self.model
        size = m.piece_at[ids + 1] - m.piece_at[ids]
        ends = np.concatenate([[0], np.cumsum(size > 0)])[ends]  # control ids decode to nothing
        ids, size = ids[size > 0], size[size > 0]
        flat = take_ragged(m.piece_bytes, m.piece_at[ids], size).tobytes()
        edges = np.concatenate([[0], np.cumsum(size)])[ends].tolist()
        first_bare = m.bare[ids[np.minimum(ends[:-1], max(0, len(ids) - 1))]] if len(ids) else np.zeros(len(ends) - 1, dtype=bool)
        out = []
        for a, b, bare in zip(edges[:-1], edges[1:], first_bare.tolist(), strict=True):
            x = flat[a:b]
            if m.dummy_prefix and x[:1] == b" " and not bare:
                x = x[1:]
            try:
                x.decode()
            except UnicodeDecodeError:
                x = _mended(x)
            out.append(x)
        return out


def _mended(x: bytes) -> bytes:
    out, i = [], 0
    while i < len(x):
        for k in (1, 2, 3, 4):
            try:
                out.append(x[i : i + k].decode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out).encode()


_CODECS: dict[int, Codec] = {}


def _codec(held) -> Codec:
    """The codec of a model; a worker that is used again keeps only the last one, with its word cache."""
    if held.value is None:
        raise ValueError("the model was not sent")
    if id(held.value) not in _CODECS:
        _CODECS.clear()
        _CODECS[id(held.value)] = Codec(held.value)
    return _CODECS[id(held.value)]


def result_names(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> tuple[str, str]:
    """The names that encode_decode() gives its results: those asked for, with underscores behind them where df has such a column in any case."""
    return free_name(df, ids), free_name(df, decoded)


def encode_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of each whole text and with the text that these ids decode to, under result_names(df, ids, decoded).

    Arrow batches go through Python once and in place: no shuffle, no state beyond a bounded word cache.
    """
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(load_model(model_path))
    ids, decoded = result_names(df, ids, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    place = df.columns.index(text)

    def run(batches):
        codec = _codec(held)
        for batch in batches:
            flat, ends = codec.encode(batch.column(place).to_pylist())
            back = codec.decode(flat, ends)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(back, type=pa.binary()).cast(pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of each list of ids, under a name that is free."""
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(load_model(model_path))
    schema = T.StructType([*df.schema.fields, T.StructField(free_name(df, decoded), T.StringType())])
    place = df.columns.index(ids)

    def run(batches):
        codec = _codec(held)
        for batch in batches:
            lists = [x or [] for x in batch.column(place).to_pylist()]
            flat = np.array([i for x in lists for i in x], dtype=np.int32)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codec.decode(flat, ends), type=pa.binary()).cast(pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Per document: number of ids, and SHA-256 of the ids and of the decoded text."""
    return df.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )


def piece_model_path() -> str:
    """The default model: a file that the tokenizer package holds on every host."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4(spark, sf_dir: str) -> DataFrame:
    from folioflow.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, piece_model_path()))
