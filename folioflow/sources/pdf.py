"""Text of PDF files: the object table, Flate streams, the page tree and the text operators of a page.

What it takes to read ordinary files and no more: no encryption, no filters but Flate, no fonts but what a
ToUnicode table or a Latin encoding says. A file that can't be read gives nulls, never an error.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PROBE_CHARS, TEXT_PAGES = 8000, 40
#: Bytes that one stream may unpack to; what lies beyond is cut off, so a small file can't fill a worker.
STREAM_BYTES = 64 << 20
#: Files of an Arrow batch.
BATCH = 8

_HEAD = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"[\0\t\n\f\r ]*(?:%[^\r\n]*[\0\t\n\f\r ]*)*(<<|>>|\[|\]|\{|\}|/[^\0\t\n\f\r ()<>\[\]{}/%]*|\(|\)|<[0-9A-Fa-f\s]*>|>|[^\0\t\n\f\r ()<>\[\]{}/%]+)")
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """The number of an object."""


class Op(bytes):
    """A bare word: an operator of a content stream, or a keyword."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses, which may nest; at is behind the first one."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            nxt = data[at : at + 1]
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            else:
                out += b"" if nxt in (b"\n", b"\r") else _ESCAPE.get(nxt, nxt)
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def values(data: bytes, at: int = 0):
    """(value, end) one by one: numbers, strings as bytes, names as str with a slash, lists, dicts, Ref and Op."""
    stack: list[list] = []
    while m := _TOKEN.match(data, at):
        t, at = m[1], m.end()
        if t in (b"<<", b"["):
            stack.append([t])
            continue
        if t in (b">>", b"]"):
            if not stack:
                continue
            top = stack.pop()
            items = top[1:]
            v = dict(zip(items[::2], items[1::2], strict=False)) if top[0] == b"<<" and all(isinstance(k, str) for k in items[::2]) else items
        elif t == b"(":
            v, at = _literal(data, at)
        elif t.startswith(b"<") and t.endswith(b">"):
            digits = re.sub(rb"\s", b"", t[1:-1])
            v = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t.startswith(b"/"):
            v = re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), t.decode("latin-1"))
        elif re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", t):
            v = float(t) if b"." in t else int(t)
        elif t == b"R" and stack and len(stack[-1]) > 2:
            stack[-1].pop()
            v = Ref(stack[-1].pop())
        else:
            v = Op(t)
        if stack:
            stack[-1].append(v)
        else:
            yield v, at


def _one(data: bytes, at: int = 0):
    return next(values(data, at), (None, at))


class Document:
    """Objects by number; of several definitions the last one counts, as in files that were updated."""

    def __init__(self, data: bytes):
        self.data, self.objects, self.streams = data, {}, {}
        at = data.find(b"%PDF")
        if at < 0:
            raise ValueError("no PDF")
        packed = []
        while m := _HEAD.search(data, at):
            number, (value, at) = int(m[1]), _one(data, m.end())
            self.objects[number] = value
            self.streams.pop(number, None)
            begin = re.compile(rb"\s*stream\r?\n").match(data, at)
            if begin and isinstance(value, dict):
                size = value.get("/Length")
                end = begin.end() + size if isinstance(size, int) and not isinstance(size, Ref) else -1
                if end < 0 or not re.compile(rb"\s*endstream").match(data, end):
                    end = data.find(b"endstream", begin.end())
                    end = len(data) if end < 0 else end
                self.streams[number] = (begin.end(), end)
                at = end
                if value.get("/Type") == "/ObjStm":
                    packed.append(number)
        if b"/Encrypt" in data and any(isinstance(v, dict) and "/Encrypt" in v for v, _ in self._trailers()):
            raise ValueError("encrypted")
        for number in packed:
            self._unpack(number)

    def _trailers(self):
        yield from ((_one(self.data, m.end())) for m in re.finditer(rb"\btrailer\b", self.data))
        yield from ((v, 0) for v in self.objects.values() if isinstance(v, dict) and v.get("/Type") == "/XRef")

    def _unpack(self, number: int) -> None:
        head, body = self.objects[number], self.stream(number)
        numbers = [v for v, _ in values(body[: head["/First"]])]
        for k, offset in zip(numbers[::2], numbers[1::2], strict=False):
            if k not in self.objects:
                self.objects[k] = _one(body, head["/First"] + offset)[0]

    def get(self, x):
        """What a reference stands for; other values are themselves."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(int(x))
        return None

    def stream(self, number: int) -> bytes:
        begin, end = self.streams[number]
        raw, head = self.data[begin:end], self.objects[number]
        filters = self.get(head.get("/Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f not in ("/FlateDecode", "/Fl"):
                raise ValueError(f"filter {f}")
            raw = zlib.decompressobj().decompress(raw, STREAM_BYTES)
        return raw

    def pages(self) -> list[dict]:
        """Pages in order, with the resources that they inherit."""
        root = next((v for v in reversed(list(self.objects.values())) if isinstance(v, dict) and v.get("/Type") == "/Catalog"), None)
        out, seen = [], set()
        todo = [(root.get("/Pages"), {})] if root else []
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            seen.add(int(ref) if isinstance(ref, Ref) else id(node))
            node = above | node
            kids = self.get(node.get("/Kids"))
            if isinstance(kids, list):
                todo += [(k, {"/Resources": node.get("/Resources")}) for k in reversed(kids)]
            else:
                out.append(node)
        return out

    def _unicode(self, font) -> tuple[dict[int, str], int]:
        """(code -> text, bytes a code) of a font's ToUnicode table; an empty table where it has none."""
        font = self.get(font)
        ref = font.get("/ToUnicode") if isinstance(font, dict) else None
        if not isinstance(ref, Ref) or int(ref) not in self.streams:
            return {}, 1
        table, width, args = {}, 1, []
        text = lambda b: b.decode("utf-16-be", "replace")
        number = lambda b: int.from_bytes(b, "big")
        for v, _ in values(self.stream(int(ref))):
            if not isinstance(v, Op):
                args.append(v)
                continue
            if v == b"endcodespacerange" and args and isinstance(args[-1], bytes):
                width = max(1, len(args[-1]))
            elif v == b"endbfchar":
                table.update({number(a): text(b) for a, b in zip(args[::2], args[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)})
            elif v == b"endbfrange":
                for a, b, to in zip(args[::3], args[1::3], args[2::3], strict=False):
                    for i in range(min(number(b) - number(a) + 1, 1 << 16)):
                        if isinstance(to, list):
                            if i < len(to) and isinstance(to[i], bytes):
                                table[number(a) + i] = text(to[i])
                        elif to:
                            table[number(a) + i] = text((number(to) + i).to_bytes(len(to), "big"))
            args = []
        return table, width

    def text(self, page: dict) -> str:
        """The strings that a page shows, a line break where the text moves to another line."""
        refs = page.get("/Contents")
        content = self.get(refs) if isinstance(refs, Ref) and int(refs) not in self.streams else refs
        parts = [self.stream(int(r)) for r in (content if isinstance(content, list) else [content]) if isinstance(r, Ref) and int(r) in self.streams]
        resources = self.get(page.get("/Resources"))
        named = self.get(resources.get("/Font")) if isinstance(resources, dict) else None
        fonts, table, width = named if isinstance(named, dict) else {}, {}, 1
        known: dict = {}
        out: list[str] = []

        def show(s) -> None:
            if isinstance(s, bytes):
                codes = [int.from_bytes(s[i : i + width], "big") for i in range(0, len(s), width)] if table else []
                out.append("".join(table.get(c, "") for c in codes) if table else s.decode("cp1252", "replace"))

        args: list = []
        for v, _ in values(b"\n".join(parts)):
            if not isinstance(v, Op):
                args.append(v)
                continue
            last = args[-1] if args else None
            if v == b"Tf" and len(args) > 1:
                name = args[-2]
                if name not in known:
                    known[name] = self._unicode(fonts.get(name))
                table, width = known[name]
            elif v in (b"Tj", b"'", b'"'):
                if v != b"Tj":
                    out.append("\n")
                show(last)
            elif v == b"TJ" and isinstance(last, list):
                for x in last:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, (int, float)) and x < -200:  # so wide a gap is a blank
                        out.append(" ")
            elif v in (b"T*", b"ET") or (v in (b"Td", b"TD") and last):
                out.append("\n")
            elif v in (b"Td", b"TD", b"Tm"):
                out.append(" " if v != b"Tm" else "\n")
            args = []
        return re.sub(r"[ \t]*\n\s*", "\n", re.sub(r"[ \t]+", " ", "".join(out))).strip()


def probe(data: bytes | None, chars: int = PROBE_CHARS) -> tuple[int | None, str | None]:
    """(pages, text of the first page, and of the second where the first one holds no DOI); nulls for what can't be read."""
    try:
        doc = Document(data or b"")
        pages = doc.pages()
    except Exception:  # broken in whatever way: a file never ends a run
        return None, None
    if not pages:
        return None, None
    texts = []
    for page in pages[:2]:
        if texts and "10." in texts[0]:
            break
        try:
            texts.append(doc.text(page))
        except Exception:
            texts.append("")
    text = "\n".join(texts)[:chars]
    return len(pages), text if text.strip() else None


def whole_text(data: bytes | None, most: int = TEXT_PAGES) -> str | None:
    """The text of the first pages with blanks as single spaces; pages that can't be read are left out."""
    try:
        doc = Document(data or b"")
        pages = doc.pages()
    except Exception:
        return None
    out = []
    for page in pages[:most]:
        try:
            out.append(doc.text(page))
        except Exception:
            continue
    return re.sub(r"\s+", " ", " ".join(out)).strip() or None


def _smaller(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def pdf_probe(files: DataFrame, content: str = "content") -> DataFrame:
    """The other columns of files with page_count and head, the first 8,000 characters; both null where a file can't be read."""
    import pyarrow as pa

    _smaller(files)
    others = [c for c in files.columns if c != content]

    def run(batches):
        for b in batches:
            found = [probe(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())], names=["row", "page_count", "head"])

    fed = files.select(F.struct(*others).alias("row"), F.col(content).alias("content"))
    schema = fed.select("row", F.lit(0).cast("int").alias("page_count"), F.lit("").alias("head")).schema
    schema["page_count"].nullable = schema["head"].nullable = True
    return fed.mapInArrow(run, schema).select("row.*", "page_count", "head")


@F.udf(StringType(), useArrow=True)
def pdf_text(content) -> str | None:
    """The text of a PDF file's first forty pages."""
    return whole_text(bytes(content) if content is not None else None)
