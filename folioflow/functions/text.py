"""String functions as column expressions; pandas UDFs only where Spark has no counterpart."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def norm_doi(x) -> Column:
    """DOI of a bibliographic record: resolver prefix and trailing punctuation go, lower case, empty is null."""
    bare = F.trim(F.regexp_replace(_c(x), r"(?i)^\s*https?://(dx\.)?doi\.org/", ""))
    return F.nullif(F.lower(F.regexp_replace(bare, r"\)*;*,*\.*$", "")), F.lit(""))


def doi_normalize(x) -> Column:
    """DOI of a ledger row: resolver and doi: prefixes go, trimmed, lower case; punctuation stays."""
    bare = F.regexp_replace(F.trim(_c(x)), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.nullif(F.lower(F.trim(F.regexp_replace(bare, r"(?i)^doi:\s*", ""))), F.lit(""))


def extract_doi(x) -> Column:
    """First DOI in a text, normalised; null without one."""
    return norm_doi(F.nullif(F.regexp_extract(_c(x), r"""\b10\.\d{3,}/[^\s"<>()]+""", 0), F.lit("")))


def doi_root(x) -> Column:
    return F.regexp_replace(F.lower(_c(x)), r"_v\d+$", "")


def is_doi_like(x) -> Column:
    return _c(x).rlike(r"(?i)^10\.\d{4,9}/")


@F.pandas_udf(T.StringType())
def _fold_title(titles: pd.Series) -> pd.Series:
    def fold(t):
        if t is None:
            return None
        keep = []
        for ch in unicodedata.normalize("NFKD", t):
            if ch.isascii():
                if ch.isalnum():
                    keep.append(ch.lower())
            elif 0x1100 <= ord(ch) <= 0x11FF or 0xAC00 <= ord(ch) <= 0xD7A3 or 0x3040 <= ord(ch) <= 0x30FF or 0x4E00 <= ord(ch) <= 0x9FFF:
                keep.append(ch)
        return "".join(keep)

    return titles.map(fold)


def norm_title(x) -> Column:
    """Title key: ASCII letters and digits in lower case, Hangul, Kana and Han, nothing else.

    ASCII titles, nearly all, stay in the JVM; only the others go through Python.
    """
    x = _c(x)
    ascii_key = F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return F.when(x.rlike(r"^[\x00-\x7F]*$"), ascii_key).otherwise(_fold_title(x))


def ascii_title(x) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def canonical_id(doi, title_norm, year) -> Column:
    """32 hex digits: of the DOI, else of title and year; year 0 counts as missing."""
    by_title = F.concat(F.lit("ttl:"), F.coalesce(_c(title_norm), F.lit("")), F.lit("|"), F.coalesce(F.nullif(_c(year), F.lit(0)).cast("string"), F.lit("")))
    key = F.coalesce(F.concat(F.lit("doi:"), norm_doi(doi)), by_title)
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 32)


def title_clean(x) -> Column:
    return F.regexp_replace(F.lower(F.trim(_c(x))), r"(?U)\s+", " ")


def count_of(text, term) -> Column:
    """Non-overlapping occurrences of a term, without regular expressions; sizes are in bytes, which need no walk over the text."""
    text, term = _c(text), _c(term)
    size = F.octet_length
    return F.when(size(term) > 0, ((size(text) - size(F.replace(text, term, F.lit("")))) / size(term)).cast("int")).otherwise(0)


def token_count(x) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(_c(x), r"(?U)\s+"), lambda t: t != "")))


# --- fixed values: tokens of the corpus table, and of salvage ----------------------------------------
CORPUS_TOKEN = r"[A-Za-z0-9_À-ɏᄀ-ᇿ぀-ヿ一-鿿가-힣]+"
SALVAGE_TOKEN = r"[A-Za-z0-9]{2,}(?:[-_][A-Za-z0-9]{2,})*|[가-힣]{2,}"
SALVAGE_LEAST = 4


def corpus_tokens(x) -> Column:
    """Tokens of a document for the corpus table: three characters at least, not digits alone."""
    found = F.regexp_extract_all(F.lower(_c(x)), F.lit(CORPUS_TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^[0-9]+$"))


def salvage_tokens(x, stop: list[str]) -> Column:
    """Tokens of sparse project texts: runs of letters and digits, joined by - or _, or of Hangul; no stop words, not digits alone."""
    found = F.regexp_extract_all(F.lower(_c(x)), F.lit(SALVAGE_TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= SALVAGE_LEAST) & ~t.isin(stop) & ~t.rlike(r"^[0-9]+$"))


def keyword_tokens(x, stop: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z]{4,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def pattern_tokens(x) -> Column:
    """Words of an exclusion message: punctuation stripped, at least four letters, letters only."""
    marks = r""".,!?;:()[]"'"""
    words = F.transform(F.split(F.lower(_c(x)), r"(?U)\s+"), lambda t: F.btrim(t, F.lit(marks)))
    return F.filter(words, lambda t: (F.length(t) >= 4) & t.rlike(r"^\p{L}+$"))


def split_values(x) -> Column:
    """Cell of several DOIs: split on ; and , normalised, distinct in order."""
    parts = F.transform(F.split(_c(x), "[;,]"), lambda t: norm_doi(F.trim(t)))
    return F.array_distinct(F.filter(parts, lambda t: t.isNotNull()))


def contains_any(text, terms: list[str]) -> Column:
    text = F.lower(_c(text))
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return F.coalesce(out, F.lit(False))


def compose(*parts, most: int | None = None) -> Column:
    """Non-blank parts, one a line, cut at `most` characters."""
    joined = F.concat_ws("\n", *[F.when(F.trim(_c(p)) != "", _c(p)) for p in parts])
    return F.substring(joined, 1, most) if most else joined


def _once(value: Column, use) -> Column:
    """use(value) with value computed once a row, not once for each element that a lambda visits."""
    return F.transform(F.array(value), use)[0]


def inverted_index(words) -> Column:
    """Map word -> positions of an array of words without nulls; one sort, so the cost does not grow with the square of its length."""

    def grouped(o):
        starts = F.filter(F.sequence(F.lit(1), F.size(o)), lambda i: (i == 1) | (F.try_element_at(o, i)["w"] != o[i - 2]["w"]))
        return _once(starts, lambda s: F.map_from_entries(F.transform(s, lambda a, k: F.struct(o[a - 1]["w"], positions(o, a, s, k)))))

    def positions(o, a, s, k):
        last = F.coalesce(F.try_element_at(s, k + 2) - 1, F.size(o))
        return F.transform(F.sequence(a, last), lambda i: o[i - 1]["p"])

    words = _c(words)
    return F.when(F.size(words) == 0, F.create_map().cast("map<string,array<int>>")).otherwise(_once(F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p")))), grouped))


def inverted_index_text(index) -> Column:
    """Text of a map word -> positions: gaps are skipped, of words at one position the last one by name stays."""
    pairs = F.flatten(F.transform(F.map_entries(_c(index)), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    last = _once(F.sort_array(pairs), lambda order: F.filter(order, lambda x, i: (i == F.size(order) - 1) | (F.try_element_at(order, i + 2)["p"] != x["p"])))
    return F.array_join(F.transform(last, lambda x: x["w"]), " ")


def xml_text(x) -> Column:
    """XML body without references, back matter, tags and entities."""
    x = F.regexp_replace(_c(x), r"(?is)<(ref-list|back)\b.*?</\1>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), r"&[#a-zA-Z0-9]+;", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


# --- fixed values: where the main text of a page may be, in order, what is no text in it, and how long it must be ----
MAIN_PLACES = ["article", "role=main", "main", ".article-fulltext", ".fulltext-view", "#bodymatter", ".c-article-body", "#content"]
NO_TEXT = {"nav", "header", "footer", ".references", "#references", "role=navigation"}
MAIN_LEAST = 1200
_UNSEEN = {"script", "style", "noscript", "template"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "source", "area", "base", "col", "embed", "track", "wbr"}


class _Main(HTMLParser):
    """Collects the text of the first element of each place: all that is shown, and what is left without NO_TEXT inside the element."""

    def __init__(self):
        super().__init__()
        self.open: list[str] = []
        self.unseen, self.dropped = 0, []  # open elements that show nothing, depths of open NO_TEXT elements
        self.begun: dict[str, int] = {"": 0}  # place -> depth; "" is the whole page
        self.live = {""}
        self.shown: dict[str, list[str]] = {"": []}
        self.kept: dict[str, list[str]] = {"": []}

    def _names(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        return {tag, f"role={at.get('role', '').strip().lower()}", f"#{at.get('id', '')}", *(f".{c}" for c in at.get("class", "").split())}

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        names = self._names(tag, attrs)
        depth = len(self.open) + 1
        for place in (*MAIN_PLACES, "body"):
            if place in names and place not in self.begun:
                self.begun[place], self.shown[place], self.kept[place] = depth, [], []
                self.live.add(place)
        self.open.append(tag)
        self.unseen += tag in _UNSEEN
        if names & NO_TEXT:
            self.dropped.append(depth)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            depth, last = len(self.open), self.open.pop()
            self.unseen -= last in _UNSEEN
            if self.dropped and self.dropped[-1] == depth:
                self.dropped.pop()
            self.live = {p for p in self.live if self.begun[p] < depth}
            if last == tag:
                break

    def handle_data(self, data):
        if data.strip() and not self.unseen:
            for place in self.live:
                self.shown[place].append(data)
                # Only what is inside the element can be taken out of it.
                if not (self.dropped and self.dropped[-1] > self.begun[place]):
                    self.kept[place].append(data)


def main_text(html: str, least: int = MAIN_LEAST) -> str:
    """The text of the first place that shows more than `least` characters, else of the body, else of the whole page."""
    page = _Main()
    page.feed(html)
    page.close()
    joined = lambda parts: " ".join(" ".join(parts).split())
    place = next((p for p in MAIN_PLACES if len(joined(page.shown.get(p, []))) > least), "body" if "body" in page.begun else "")
    return joined(page.kept[place])


@F.pandas_udf(T.StringType())
def html_main(pages: pd.Series) -> pd.Series:
    """main_text() of HTML pages; null stays null."""
    return pages.map(lambda html: None if html is None else main_text(html))


def full_text(xml, pdf, html, least: int = 1500) -> Column:
    """First of the forms with enough text, else 'unavailable'."""
    return F.coalesce(*[F.when(F.length(_c(x)) > least, _c(x)) for x in (xml, pdf, html)], F.lit("unavailable"))


def parse_filename(x) -> Column:
    """Struct author, year, title, truncated of Author_YYYY_Title.pdf."""
    base = F.regexp_extract(_c(x), r"([^/]*)$", 1)
    pattern = r"(?i)^([^_\d]{1,40}?)_((?:18|19|20)\d{2})_(.+)\.pdf$"
    stem = F.regexp_replace(base, r"(?i)\.pdf$", "")
    hit = base.rlike(pattern)
    part = lambda i: F.when(hit, F.trim(F.regexp_extract(base, pattern, i)))
    title = F.trim(F.replace(F.coalesce(part(3), stem), F.lit("_"), F.lit(" ")))
    return F.struct(part(1).alias("author"), part(2).cast("int").alias("year"), title.alias("title"), (~hit & (F.length(stem) < 30) & ~stem.contains("_")).alias("truncated"))


def chars_without_space(x) -> Column:
    return F.length(F.regexp_replace(_c(x), r"(?U)\s", ""))


NO_GIST = "(no project description available)"  # fixed value


def gist(titles, questions, words: int = 60) -> Column:
    """Each project's title and its question, if that is under 200 characters, in one line cut to so many words. Blank ones are left out."""
    short = lambda q: F.when(F.length(q) < 200, q)
    some = lambda x: F.nullif(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(""))
    parts = F.array_compact(F.flatten(F.zip_with(_c(titles), _c(questions), lambda t, q: F.array(some(t), some(short(q))))))
    raw = F.array_join(parts, " ")
    split = F.filter(F.split(raw, r"(?U)\s+"), lambda w: w != "")
    cut = F.when(F.size(split) > words, F.concat(F.array_join(F.slice(split, 1, words), " "), F.lit("…"))).otherwise(raw)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(NO_GIST))


def lcs_masks(a: str) -> dict[str, int]:
    """Places of each character of a, as bits."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    return at


def lcs_of(at: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of a text of n characters, given by its masks, and b; one machine word row per character of b."""
    row = mask = (1 << n) - 1
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & mask
    return n - row.bit_count()


def _lcs(a: str, b: str) -> int:
    return lcs_of(lcs_masks(a), len(a), b)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (len a + len b); 0 if either is missing."""
    return pd.Series([2 * _lcs(x, y) / (len(x) + len(y)) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def matching_blocks(a: str, b: str) -> float:
    """Ratio by recursive longest matching blocks; 0 if either is empty."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio by recursive longest matching blocks."""
    return pd.Series([matching_blocks(x, y) for x, y in zip(a, b, strict=True)])


def titles_equal(a, b, least: float = 0.9) -> Column:
    a, b = title_clean(a), title_clean(b)
    return F.when((a == b) & (a != ""), True).otherwise(matching_blocks_ratio(a, b) >= least)


def month(x) -> Column:
    """Year and month of a date text."""
    return F.substring(_c(x), 1, 7)


def unit_file(x) -> Column:
    """A unit's id as part of a file name."""
    return F.replace(_c(x), F.lit("+"), F.lit("_"))


def note(x) -> Column:
    """A note that ends in punctuation; notes of the classifier stay as they are."""
    x = _c(x)
    bare = F.trim(x)
    return F.when(x.startswith("keyword-classifier ("), x).when(bare.rlike(r"[.!?]$"), bare).otherwise(F.concat(bare, F.lit(".")))


def one_of(x, allowed: list[str], default: str) -> Column:
    """A value of a closed list; anything else is the default."""
    return F.when(_c(x).isin(allowed), _c(x)).otherwise(F.lit(default))


def as_array(x) -> Column:
    """Strings of a JSON list; another value is a list of one, none an empty list."""
    x = F.trim(_c(x))
    items = F.from_json(x, "array<string>")
    return F.when(F.coalesce(x, F.lit("")).isin("", "null"), F.array().cast("array<string>")).when(x.startswith("["), F.coalesce(items, F.array(x))).otherwise(F.array(x))


def frameworks_ok(x) -> Column:
    """Whether a JSON text is a list of objects that each have a string as name."""
    x = F.trim(_c(x))
    each = F.from_json(x, "array<string>")
    sound = F.forall(each, lambda f: F.coalesce(f.startswith("{") & F.get_json_object(f, "$.name").isNotNull() & f.rlike(r'"name"\s*:\s*"'), F.lit(False)))
    return F.coalesce(x.startswith("[") & sound, F.lit(False))
