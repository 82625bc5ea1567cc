"""Values of JSON texts, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings and the brackets around them; the string's pattern never steps back, however long it is.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}:]'


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def parsed_or(x, default: str = "{}") -> Column:
    """A JSON text as variant; what is null, blank or no JSON counts as `default` (a JSON text)."""
    return F.coalesce(F.try_parse_json(_c(x)), F.parse_json(F.lit(default)))


def parsed_or_text(x) -> Column:
    """A JSON text as variant; another text as a variant that holds the text itself; null stays null."""
    x = _c(x)
    return F.coalesce(F.try_parse_json(x), x.cast("variant"))


def string_leaves(x, depth: int = 4) -> Column:
    """The strings in a JSON text, in their order; keys are none. What is no JSON has none.

    Each object and each list takes one level. An object below the first `depth` levels is not entered; a list is
    entered however deep it lies. The text is read token by token, since a parsed value would no longer have its
    keys in order.
    """
    x = _c(x)

    def read(tokens: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            tok, opens, closes = t["tok"], t["tok"].isin("{", "["), t["tok"].isin("}", "]")
            level = F.when(opens, acc["level"] + 1).when(closes, acc["level"] - 1).otherwise(acc["level"])
            shut = F.when((acc["shut"] < 0) & (tok == "{") & (acc["level"] >= depth), acc["level"]).when(closes & (acc["shut"] == level), F.lit(-1)).otherwise(acc["shut"])
            leaf = tok.startswith('"') & ~F.coalesce(t["next"] == ":", F.lit(False)) & (acc["shut"] < 0)
            value = F.get_json_object(F.concat(F.lit("["), tok, F.lit("]")), "$[0]")
            return F.struct(level.alias("level"), shut.alias("shut"), F.when(leaf, F.concat(acc["out"], F.array(value))).otherwise(acc["out"]).alias("out"))

        none = F.array().cast("array<string>")
        pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.struct(a.alias("tok"), b.alias("next")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("level"), F.lit(-1).alias("shut"), none.alias("out")), step, lambda acc: acc["out"])

    tokens = F.regexp_extract_all(x, F.lit(_TOKEN), F.lit(0))
    # Bound once: the tokens are named several times.
    read_once = F.transform(F.array(tokens), read)[0]
    return F.when(F.try_parse_json(x).isNotNull(), read_once).otherwise(F.array().cast("array<string>"))


def _fields(x) -> Column:
    """A JSON object as map of variants, the last of equal keys; what is no object is an empty one."""
    m = F.from_json(_c(x), "map<string,variant>")
    none = F.from_json(F.lit("{}"), "map<string,variant>")
    last = F.filter(F.map_entries(m), lambda e, i: ~F.exists(F.slice(F.map_entries(m), i + 2, F.greatest(F.size(m), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.coalesce(F.when(F.size(m) > 0, F.map_from_entries(last)), none)


def json_size(x) -> Column:
    """Items of a JSON list; 0 for null and for what is no list."""
    return F.coalesce(F.json_array_length(_c(x)), F.lit(0))


def json_has(x, key: str) -> Column:
    """Whether a JSON object has a key, a null value included."""
    return F.map_contains_key(_fields(x), key)


def json_merged(x, y) -> Column:
    """One object of two, as text: of keys that both have, the second's value. What is no object counts as an empty one."""
    a, b = _fields(x), _fields(y)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def like_any(x, *patterns: str) -> Column:
    """ILIKE any of some patterns; null is none."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.ilike(_c(x), F.lit(p))
    return F.coalesce(out, F.lit(False))
