"""Quality rules: a threshold table compiled into one Spark projection.

Each text is split into words and lines once. Counts of length, symbols, stop words and lines follow from
them as built-in expressions, and each row of the threshold table becomes one comparison of two counts,
low * of <= 100 * count <= high * of, in whole numbers. Nothing is shuffled and no user function runs.

Words are runs of anything but the characters 9 to 13 and 32. Five-word windows are compared by their 64-bit
hashes first; only a text in which a hash comes twice sorts its windows, and then by hash and words, so that
the number of repeated words is exact and takes n log n steps.

Defined results: a null text is the empty text; it and a text without words have no words and fail; repeated
rows are judged each; an empty table has an empty result; further columns, of any name, stay in judge(), whose
result column takes a name that is free; a null key stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import free_name, table

BLANK = r"[\x20\x09-\x0D]"
WINDOW = 5
#: Characters that count as symbols, fixed by the query's contract.
SYMBOLS = "#*$%&|<>"
#: Words that any running text holds, of the four languages of the documents.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "as", "it", "on", "be",
    "de", "la", "le", "les", "des", "et", "en", "un", "une", "du", "que", "qui", "dans", "pour", "est", "au",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "nicht", "auf", "im", "sich", "auch",
    "el", "los", "las", "y", "se", "del", "por", "una", "con", "para", "no", "su", "al",
]


@dataclass(frozen=True)
class Rule:
    """A text passes if low * of <= 100 * count <= high * of; either bound may be missing. `of` is a count, or "" for 1."""

    name: str
    count: str
    of: str
    low: int | None = None
    high: int | None = None


#: Failing one of these is final, fixed by the query's contract.
BASE = [
    Rule("few_words", "n_words", "", low=1000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=20),
]
#: The method's own thresholds, in hundredths.
TABLE = [
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=40),
    Rule("bangs", "n_bangs", "n_words", high=40),
    Rule("capitals", "n_capitals", "word_chars", high=40),
    Rule("stop_words", "n_stop_words", "n_words", low=4),
    Rule("same_lines", "n_dup_lines", "n_lines", high=30),
]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often use names it."""
    return F.transform(F.array(value), use)[0]


def _only(text: Column, characters: str) -> Column:
    """How many characters of the class text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _repeated(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more."""
    n = F.size(words) - (WINDOW - 1)
    windows = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(WINDOW)])

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(F.xxhash64(x).alias("h"), x.alias("w"), i.alias("at"))))

        def flagged(s: Column) -> Column:
            same = lambda x, y: y.isNotNull() & (x["h"] == y["h"]) & (x["w"] == y["w"])
            hit = F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["at"]))
            return F.sort_array(F.array_compact(hit))

        def total(at: Column) -> Column:
            steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return bound(bound(placed, flagged), total)

    def told(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long"))

    return F.when(n > 1, bound(windows, told)).otherwise(F.lit(0).cast("long"))


def counts(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Struct of every count that a threshold may name."""

    def of_words(t: Column, words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _only(t, SYMBOLS).alias("n_symbols"),
            _only(t, "!").alias("n_bangs"),
            _only(t, "A-Z").alias("n_capitals"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(stop_words))).cast("long").alias("n_stop_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated(words).alias("n_repeat_words"),
        )

    def of(t: Column) -> Column:
        # A blank at either end of the text leaves an empty first or last piece.
        words = F.array_remove(F.split(t, BLANK + "+"), "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return bound(words, lambda w: bound(lines, lambda x: of_words(t, w, x)))

    return bound(F.coalesce(text.cast("string"), F.lit("")), of)


def _passes(rule: Rule, count: Callable[[str], Column]) -> Column:
    of = count(rule.of) if rule.of else F.lit(1).cast("long")
    value, ok = 100 * count(rule.count), F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= rule.low * of)
    if rule.high is not None:
        ok = ok & (value <= rule.high * of)
    return ok


def failed(rules: list[Rule], count: Callable[[str], Column]) -> Column:
    """Names of the rules that fail, in the order of the table."""
    return F.array_compact(F.array(*[F.when(~_passes(r, count), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")


def verdict(text: Column, base: list[Rule] = BASE, rules: list[Rule] = TABLE, stop_words: list[str] = STOP_WORDS) -> Column:
    """Struct of all counts, base_failed, failed (names of the failing rules of both tables) and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_bangs", "n_capitals", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]

    def judged(c: Column) -> Column:
        both = lambda of: F.struct(*[c[n].alias(n) for n in names], (F.size(of["base"]) > 0).alias("base_failed"), F.concat(of["base"], of["more"]).alias("failed"), (F.size(of["base"]) + F.size(of["more"]) == 0).alias("kept"))
        return bound(F.struct(failed(base, lambda n: c[n]).alias("base"), failed(rules, lambda n: c[n]).alias("more")), both)

    return bound(counts(text, stop_words), judged)


def judge(df: DataFrame, text: str = "text", out: str = "quality_verdict", base: list[Rule] = BASE, rules: list[Rule] = TABLE, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """df with the struct of verdict() as a further column; where df has a column of that name, underscores are put behind it."""
    return df.withColumn(free_name(df, out), verdict(F.col(f"`{text}`"), base, rules, stop_words))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), out="v")
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bangs", "n_capitals", "n_stop_words", "n_lines"]
    return seen.select("doc_id", *[F.col(f"v.{c}").alias(c) for c in shown], F.array_join("v.failed", ",").alias("failed"))


def _sql_fails(rule: Rule) -> str:
    of = rule.of or "1"
    low = [f"100 * {rule.count} < {rule.low} * {of}"] if rule.low is not None else []
    high = [f"100 * {rule.count} > {rule.high} * {of}"] if rule.high is not None else []
    return " OR ".join(low + high)


def op11_sql() -> str:
    """The same table of thresholds over counts that SQL makes by grouping windows and lines."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    case = lambda r: f"CASE WHEN {_sql_fails(r)} THEN '{r.name}' END"
    return rf"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                     [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
        windows AS (SELECT r, i, list_slice(words, i, i + 4) AS win FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
        covered AS (SELECT r, sum(step) AS n FROM (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS step FROM twice) GROUP BY r),
        c AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_bangs, CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
                CAST(len([x FOR x IN words IF lower(x) IN ({stop})]) AS BIGINT) AS n_stop_words,
                CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
              FROM w LEFT JOIN covered USING (r))
        SELECT *, concat_ws(',', {", ".join(map(case, BASE + TABLE))}) AS failed,
          {" OR ".join(_sql_fails(r) for r in BASE)} AS base_failed, NOT ({" OR ".join(_sql_fails(r) for r in BASE + TABLE)}) AS kept
        FROM c
    """
