"""Media columns: storing, signature sniffing, type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over the bytes. Each
hit is only a guess until the format's validator has walked the structure from there (chunk lengths,
checksums, end markers) and so knows the length. A valid file at offset 0 gives the column's type; valid
files further in are carved.

Defined results: null or empty bytes have no type, no length and nothing carved; a declared type is kept
where nothing valid starts at offset 0; files inside a validated file are reported too, files that are
cut off are not; repeated rows have equal results; an empty table has an empty result; other columns stay, but
store_text() replaces columns that have the names of its two results (pass other names for these).
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import small_batches, table

FRAME = 576
HEADER = 44


# --- validators: the length of a valid file that starts at i, else 0 --------------------------------


def _png(b: bytes, i: int) -> int:
    at, seen = i + 8, False
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        end = at + 12 + n
        if end > len(b) or zlib.crc32(b[at + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0] or (not seen and kind != b"IHDR"):
            return 0
        seen, at = True, end
        if kind == b"IEND":
            return at - i
    return 0


def _gif(b: bytes, i: int) -> int:
    if i + 13 > len(b):
        return 0
    flags = b[i + 10]
    at = i + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += b[at] + 1
        return at + 1

    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 - i
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 <= len(b):
            local = b[at + 9]
            at = blocks(at + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, i: int) -> int:
    at = i + 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xD9:
            return at + 2 - i
        if marker in (0, 0xFF) or 0xD0 <= marker <= 0xD8:
            return 0
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        if marker == 0xDA:  # entropy-coded data runs to the next marker that is neither a stuffed byte nor a restart
            while (at := b.find(b"\xff", at)) >= 0 and at + 1 < len(b) and (b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return 0
    return at + 2 - i if b[at : at + 2] == b"\xff\xd9" else 0


def _riff(kind: bytes, first: bytes):
    def check(b: bytes, i: int) -> int:
        if b[i + 8 : i + 12] != kind:
            return 0
        end, at, seen = i + 8 + int.from_bytes(b[i + 4 : i + 8], "little"), i + 12, set()
        if end > len(b):
            return 0
        while at + 8 <= end:
            seen.add(b[at : at + 4])
            n = int.from_bytes(b[at + 4 : at + 8], "little")
            at += 8 + n + (n & 1)
        return end - i if at == end and any(x.startswith(first) for x in seen) else 0

    return check


def _bmp(b: bytes, i: int) -> int:
    if i + 30 > len(b):
        return 0
    n, reserved, at, header = struct.unpack_from("<IIII", b, i + 2)
    planes, bits = struct.unpack_from("<HH", b, i + 26)
    ok = not reserved and header in (40, 52, 56, 108, 124) and 14 + header <= at <= n and i + n <= len(b) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return n if ok else 0


def _pdf(b: bytes, i: int) -> int:
    last = b.rfind(b"%%EOF", i)
    return last + 5 - i if last > 0 and b.find(b"startxref", i, last) > 0 else 0


def _zip(b: bytes, i: int) -> int:
    at = i
    while b[at : at + 4] == b"PK\x03\x04" and at + 30 <= len(b):
        flags, packed, name, extra = *struct.unpack_from("<H", b, at + 6), *struct.unpack_from("<I", b, at + 18), *struct.unpack_from("<HH", b, at + 26)
        if flags & 8:
            return 0
        at += 30 + packed + name + extra
    while b[at : at + 4] == b"PK\x01\x02" and at + 46 <= len(b):
        at += 46 + sum(struct.unpack_from("<HHH", b, at + 28))
    return at + 22 + struct.unpack_from("<H", b, at + 20)[0] - i if b[at : at + 4] == b"PK\x05\x06" and at + 22 <= len(b) else 0


def _gzip(b: bytes, i: int) -> int:
    d = zlib.decompressobj(31)
    try:
        at = i
        while at < len(b) and not d.eof:  # what it holds is thrown away piece by piece
            d.decompress(b[at : at + 65536])
            at += 65536
    except zlib.error:
        return 0
    return min(at, len(b)) - i - len(d.unused_data) if d.eof else 0


def _ogg(b: bytes, i: int) -> int:
    at, last = i, False
    while b[at : at + 4] == b"OggS" and at + 27 <= len(b) and not b[at + 4]:
        n = b[at + 26]
        last = bool(b[at + 5] & 4)
        at += 27 + n + sum(b[at + 27 : at + 27 + n])
        if at > len(b):
            return 0
    return at - i if last else 0


#: Magic bytes, type, offset of the magic in the file, validator: fixed by the formats.
FORMATS = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _riff(b"WAVE", b"data")),
    (b"RIFF", "image/webp", _riff(b"WEBP", b"VP8")),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
]


@cache
def _automaton():
    import ahocorasick

    found: dict[str, list[tuple[str, object]]] = {}
    for magic, kind, check in FORMATS:
        found.setdefault(magic.decode("latin-1"), []).append((kind, check))
    auto = ahocorasick.Automaton()
    for magic, ways in found.items():
        auto.add_word(magic, (len(magic), ways))
    auto.make_automaton()
    return auto


def files_in(b: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid files in b, by offset."""
    out = []
    for end, (n, ways) in _automaton().iter(b.decode("latin-1")):
        i = end + 1 - n
        out += [(i, size, kind) for kind, check in ways if (size := check(b, i))]
    return out


def samples_of(b: bytes) -> bytes:
    """The samples of a valid 8-bit WAV file."""
    at = 12
    while at + 8 <= len(b):
        n = int.from_bytes(b[at + 4 : at + 8], "little")
        if b[at : at + 4] == b"data":
            return b[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    return b""


SNIFFED = "type string, length long, corrected boolean, carved array<struct<offset:long,length:long,type:string>>, samples_at long, n_samples long, mean double, rms double, crossings long, peak long"


def sniff(content: str, declared: str) -> Column:
    """Struct: the type (the declared one where nothing valid is found), the valid length, whether the declared type was wrong, the files further in, and of 8-bit sound its place and features."""

    @F.pandas_udf(SNIFFED)
    def inspect(blobs: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        rows = []
        for b, kind in zip(blobs, kinds, strict=True):
            found = files_in(b) if b else []
            whole = next((x for x in found if x[0] == 0), None)
            row = {"type": whole[2] if whole else kind, "length": whole[1] if whole else None, "corrected": bool(whole and whole[2] != kind)}
            row["carved"] = [{"offset": i, "length": n, "type": t} for i, n, t in found if i]
            x = np.frombuffer(samples_of(b), dtype=np.uint8) if whole and whole[2] == "audio/wav" and b[34:36] == b"\x08\x00" else np.zeros(0, np.uint8)
            row |= {"samples_at": None, "n_samples": len(x), "mean": None, "rms": None, "crossings": None, "peak": None}
            if len(x):
                count = np.bincount(x, minlength=256)
                level = np.arange(256) - 128
                high = x > 127
                row |= {"samples_at": b.index(b"data") + 8, "mean": float(count @ level) / len(x), "rms": float(np.sqrt((count @ level**2) / len(x))), "crossings": int(np.count_nonzero(high[1:] != high[:-1])), "peak": int(np.abs(level[count > 0]).max())}
            rows.append(row)
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in SNIFFED.replace("array<struct<offset:long,length:long,type:string>>", "x").split(", ")])
        return out.astype({c: "Int64" for c in ("length", "samples_at", "n_samples", "crossings", "peak")})

    return inspect(F.col(content), F.col(declared))


def _le(n: Column, size: int) -> Column:
    """An integer as little-endian bytes."""
    digits = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, 7 - 2 * k, 2) for k in range(size)]))


def wav_of(payload: Column, rate: int = 8000) -> Column:
    """A mono 8-bit PCM WAV file whose samples are the payload (of even length)."""
    n = F.octet_length(payload)
    return F.concat(
        F.lit(bytearray(b"RIFF")), _le(n + 36, 4), F.lit(bytearray(b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data")), _le(n, 4), payload,
    )


def store_text(df: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """df with the size of the text's UTF-8 (n_bytes) and with it, padded by bytes 255 to whole frames, as a WAV file (media)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    pad = F.greatest(F.ceil(n / FRAME), F.lit(1)) * FRAME - n
    whole = wav_of(F.concat(raw, F.unhex(F.repeat(F.lit("FF"), pad.cast("int")))))
    return df.withColumns({n_bytes: n.cast("long"), media: whole})


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 200)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = store_text(docs).drop("text").withColumn("declared", F.lit("application/octet-stream"))
    seen = stored.withColumn("s", sniff("media", "declared"))
    payload = F.expr("substring(media, CAST(s.samples_at AS INT) + 1, CAST(s.n_samples AS INT))")
    tail = F.expr("substring(media, CAST(s.samples_at + s.n_samples AS INT) - 31, 32)")
    feature = F.format_string("%s;samples=%d;mean=%.6f;rms=%.6f;crossings=%d;peak=%d;carved=%d", *[F.col(f"s.{c}") for c in ("type", "n_samples", "mean", "rms", "crossings", "peak")], F.size("s.carved"))
    return seen.select(
        "doc_id", "n_bytes", F.col("s.n_samples").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
