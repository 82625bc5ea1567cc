"""Readers and writers of the record formats."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER = (
    "canonical_id string, doi string, title string, title_norm string, authors array<string>, venue string, year int, pub_date string, "
    "is_preprint boolean, abstract string, page_count int, pdf_path string, first_seen_at timestamp, last_updated_at timestamp"
)
SYNOPSIS = "canonical_id string, core_question string, coverage string, frameworks array<struct<name:string,role:string,one_line:string>>, out_of_scope_note string, review_status string"


#: Schemas that no ledger may be in.
RESERVED_SCHEMAS = ("public", "information_schema", "pg_catalog")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; only the newline ends a line, not U+2028; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_confirmed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a log whose `confirmed` is a positive number; what is no number goes."""
    return spark.read.option("header", True).csv(path).where(F.col("confirmed").try_cast("int") > 0)


def read_json_dir(spark: SparkSession, path: str, schema: str = SYNOPSIS, key: str = "canonical_id") -> tuple[DataFrame, DataFrame]:
    """(records, problems) of a folder with one object a file; the file's name is the key, whatever the body says."""
    raw = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    named = raw.withColumn("_key", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    good = named.where(F.col("_bad").isNull())
    # One expression over both columns: the corrupt-record column cannot be read alone.
    problem = F.when(F.col("_bad").isNotNull(), "unreadable").when(F.col(key) != F.col("_key"), "key differs")
    problems = named.select("_key", problem.alias("problem")).where(F.col("problem").isNotNull())
    return good.withColumn(key, F.col("_key")).drop("_key", "_bad").dropDuplicates([key]), problems


def read_stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one object of a stage's JSON file; a missing file is an error, as the stage before has not run."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("multiLine", True).json(path)


CANDIDATE_FILE = "doi string, title string, venue string, date string, composite double, best_dim string, tier string, grounding string"


def write_stage(df: DataFrame, path: str) -> None:
    """Writes a table of one row as a stage's JSON file: beside it first, then under its name, so that a reader sees the old file or the new one."""
    spark = df.sparkSession
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a stage is one object")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(beside)
    try:
        out.write(bytearray(rows[0].encode()))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(beside), files.makeQualified(target), over)


def read_vectors(spark: SparkSession, path: str, model: str, store: DataFrame | None = None) -> DataFrame:
    """(canonical_id, embedding) of a model from a JSONL file, or, where there is no such file, from the store's table; the last row of an id counts.

    store: canonical_id, model_name, embedding_json.
    """
    if exists(spark, path):
        rows = read_jsonl(spark, path, "canonical_id string, model_name string, embedding_json array<double>").select("canonical_id", "model_name", F.col("embedding_json").alias("embedding"), F.monotonically_increasing_id().alias("_at"))
    elif store is not None:
        rows = store.select("canonical_id", "model_name", F.from_json("embedding_json", "array<double>").alias("embedding"), F.monotonically_increasing_id().alias("_at"))
    else:
        raise FileNotFoundError(path)
    mine = rows.where((F.col("model_name") == model) & F.col("canonical_id").isNotNull())
    return mine.groupBy("canonical_id").agg(F.max_by("embedding", "_at").alias("embedding"))


def read_parameters(spark: SparkSession, path: str, schema: str, missing: str = "error") -> DataFrame:
    """A parameter table from JSON; where the file is missing, an error, or no rows if `missing` is "empty"."""
    if missing not in ("error", "empty"):
        raise ValueError("missing is error or empty")
    if not exists(spark, path):
        if missing == "error":
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def tables_there(spark: SparkSession, wanted: dict[str, list[str]]) -> DataFrame:
    """(table, column, there): whether the catalog has the tables and columns that a run needs; a table's own row has no column."""
    rows = []
    for name, columns in wanted.items():
        there = spark.catalog.tableExists(name)
        have = {c.name.lower() for c in spark.catalog.listColumns(name)} if there else set()
        rows += [(name, None, there)] + [(name, c, c.lower() in have) for c in columns]
    return spark.createDataFrame(rows, "table string, column string, there boolean")


def read_candidates(spark: SparkSession, path: str, units: DataFrame, prefix: str = "scout_") -> DataFrame:
    """(unit_id, position, the fields of CANDIDATE_FILE) of the candidate files of some units: <prefix><unit>.json with a list `candidates`."""
    from folioflow.functions.text import unit_file

    raw = spark.read.schema(f"candidates array<struct<{CANDIDATE_FILE.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).option("pathGlobFilter", f"{prefix}*.json").json(path)
    named = raw.withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), rf"^{prefix}(.*)\.json$", 1))
    files = units.select("unit_id", unit_file("unit_id").alias("_file")).distinct()
    each = named.join(files, "_file").select("unit_id", F.posexplode("candidates").alias("position", "c"))
    return each.select("unit_id", (F.col("position") + 1).alias("position"), "c.*")


def paper_rows(df: DataFrame, now: Column, *more: str) -> DataFrame:
    """Records in the shape of PAPER, and further columns of df: missing columns are null, lists and flags have defaults, both timestamps are always set."""
    fields = [c.strip().split(" ", 1) for c in PAPER.split(", ")]
    defaults = {"authors": F.array().cast("array<string>"), "is_preprint": F.lit(False), "title_norm": F.lit(""), "first_seen_at": now, "last_updated_at": now}
    there = {c.lower() for c in df.columns}
    value = lambda c, kind: F.coalesce(F.col(c).cast(kind) if c in there else F.lit(None).cast(kind), *([defaults[c].cast(kind)] if c in defaults else []))
    return df.select(*[value(c, kind).alias(c) for c, kind in fields], *more)


def schema_name(name: str, foreign: tuple[str, ...] = ()) -> str:
    """A schema's name that may stand in a statement: a plain word, and none that is reserved or belongs to someone else (foreign)."""
    import re

    name = name.strip()
    if name in (*RESERVED_SCHEMAS, *foreign) or not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", name):
        raise ValueError(f"{name!r} cannot be the schema")
    return name


def read_pdf_dir(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of PDF files below a folder, without hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return named.where(~F.col("name").startswith(".")).select("path", "name", "content")


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """Term list of a lexicon file: blank lines and comments go, lower case, longest first. A bounded parameter table."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#")).distinct()
    return [r["t"] for r in lines.orderBy(F.desc(F.length("t")), "t").collect()]


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(unit, member, position) of a YAML registry: units with a list of members."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    units = (yaml.safe_load(text) or {}).get("units", {})
    rows = [(u, m, i) for u, v in units.items() for i, m in enumerate((v or {}).get("members", []))]
    return spark.createDataFrame(rows, "unit string, member string, position int")


def sql(spark: SparkSession, query: str, **args) -> DataFrame:
    """A parameterised query; values are bound, never spliced."""
    from folioflow.operators.guard import read_only

    if not read_only(spark, query):
        raise ValueError("only single queries are allowed")
    return spark.sql(query, args=args)


def as_json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON objects, for an API's edge."""
    return df.select(F.to_json(F.struct("*")).alias("row"))


# --- bibliographic APIs: records as they come, to the candidate shape -------------------------------

CANDIDATE = ["title", "doi", "url", "pdf_url", "authors", "venue", "date", "is_preprint", "abstract", "source"]


def _shape(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(c, F.lit(None)).alias(c) for c in CANDIDATE[:-1]], F.lit(source).alias("source"))


def from_works(df: DataFrame) -> DataFrame:
    """Works with an inverted abstract index and nested locations."""
    from folioflow.functions.text import doi_normalize, inverted_index_text

    place = F.col("primary_location")
    authors = F.array_compact(F.transform("authorships", lambda a: a["author"]["display_name"]))
    preprint = F.coalesce(F.lower("type").contains("preprint"), F.lit(False)) | F.coalesce(place["source"]["type"] == "repository", F.lit(False))
    return _shape(df, "works", title=F.col("title"), doi=doi_normalize("doi"), url=place["landing_page_url"], pdf_url=place["pdf_url"], authors=authors, venue=place["source"]["display_name"], date=F.col("publication_date"), is_preprint=preprint, abstract=inverted_index_text("abstract_inverted_index"))


WORK = (
    "id string, title string, doi string, type string, publication_date string, publication_year string, "
    "primary_location struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string,type:string>>, "
    "authorships array<struct<is_corresponding:boolean,author:struct<id:string,display_name:string>>>, abstract_inverted_index map<string,array<int>>"
)


def work_papers(works: DataFrame, now: Column, author: Column | None = None) -> DataFrame:
    """Records in the shape of PAPER from works (fields of WORK), with source_payload: id, type, and of `author`, the end of an id, position and whether corresponding.

    Any part of a work may be missing, authors without an author too: blank names go, a year that is none is null.
    """
    from folioflow.functions.text import canonical_id, inverted_index_text, norm_doi, norm_title

    place = F.col("primary_location.source")
    names = F.filter(F.transform("authorships", lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), lambda n: n != "")
    preprint = F.coalesce(F.lower("type").contains("preprint"), F.lit(False)) | F.coalesce(F.lower(place["type"]) == "repository", F.lit(False))
    year = F.nullif(F.col("publication_year").try_cast("int"), F.lit(0))
    is_them = lambda a: F.coalesce(F.coalesce(a["author"]["id"], F.lit("")).endswith(author), F.lit(False))
    position = F.nullif(F.array_position(F.transform("authorships", is_them), True), F.lit(0)) if author is not None else F.lit(None).cast("long")
    corresponding = F.coalesce(F.exists("authorships", lambda a: is_them(a) & F.coalesce(a["is_corresponding"], F.lit(False))), F.lit(False)) if author is not None else F.lit(None).cast("boolean")
    payload = F.struct(F.col("id").alias("work_id"), F.col("type").alias("type"), position.alias("position"), corresponding.alias("is_corresponding"))
    shaped = works.withColumn("_title", F.nullif(F.trim("title"), F.lit(""))).select(
        norm_doi("doi").alias("doi"), F.col("_title").alias("title"), F.coalesce(norm_title("_title"), F.lit("")).alias("title_norm"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.nullif(place["display_name"], F.lit("")).alias("venue"),
        year.alias("year"), F.nullif("publication_date", F.lit("")).alias("pub_date"), preprint.alias("is_preprint"), inverted_index_text("abstract_inverted_index").alias("abstract"), payload.alias("source_payload"),
    )
    named = shaped.withColumn("canonical_id", canonical_id("doi", "title_norm", "year"))
    return paper_rows(named, now, "source_payload")


def looked_up_papers(dois: DataFrame, works: DataFrame, now: Column) -> DataFrame:
    """A record for each distinct DOI of `dois` (doi): of the work with this DOI, else a stub that has the DOI alone. Of several works the one with the largest id counts."""
    from folioflow.functions.text import canonical_id, norm_doi

    wanted = dois.select(norm_doi("doi").alias("doi")).where("doi IS NOT NULL").distinct()
    known = work_papers(works, now).where("doi IS NOT NULL")
    fields = [c for c in known.columns if c != "doi"]
    one = known.groupBy("doi").agg(F.max_by(F.struct(*fields), F.coalesce("source_payload.work_id", F.lit(""))).alias("r"))
    met = wanted.join(one, "doi", "left").select("doi", *[F.col(f"r.{c}").alias(c) for c in fields])
    stub = met.withColumn("canonical_id", F.coalesce("canonical_id", canonical_id("doi", F.lit(None).cast("string"), F.lit(None).cast("int"))))
    return paper_rows(stub, now, "source_payload")


def from_europe(df: DataFrame) -> DataFrame:
    from folioflow.functions.text import doi_normalize

    return _shape(df, "europe", title=F.col("title"), doi=doi_normalize("doi"), authors=F.split("authorString", r",\s*"), venue=F.col("journalTitle"), date=F.col("firstPublicationDate"), is_preprint=F.coalesce(F.col("source") == "PPR", F.lit(False)), abstract=F.col("abstractText"))


def from_atom(df: DataFrame) -> DataFrame:
    """Entries of an Atom feed: a column `entry` with the XML of one entry."""
    x = F.from_xml(F.col("entry"), "title string, id string, published string, summary string, author array<struct<name:string>>")
    df = df.withColumn("e", x)
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return _shape(df, "atom", title=clean(F.col("e.title")), url=F.col("e.id"), authors=F.transform("e.author", lambda a: a["name"]), date=F.substring("e.published", 1, 10), is_preprint=F.lit(True), abstract=clean(F.col("e.summary")))


def from_graph(df: DataFrame) -> DataFrame:
    from folioflow.functions.text import doi_normalize

    return _shape(df, "graph", title=F.col("title"), doi=doi_normalize(F.col("externalIds.DOI")), url=F.col("url"), pdf_url=F.col("openAccessPdf.url"), authors=F.transform("authors", lambda a: a["name"]), venue=F.col("venue"), date=F.col("publicationDate"), is_preprint=F.coalesce(F.lower("venue").rlike("rxiv"), F.lit(False)), abstract=F.col("abstract"))


def choose_author(found: DataFrame, hint: Column) -> DataFrame:
    """(name, author_id): by the number of the hint's words in the affiliation, then by works."""
    words = F.filter(F.split(F.lower(hint), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4)
    score = F.size(F.filter(words, lambda w: F.lower(F.coalesce(F.col("affiliation"), F.lit(""))).contains(w)))
    return found.groupBy("name").agg(F.max_by("author_id", F.struct(score, "works_count", "author_id")).alias("author_id"))


def full_text(df: DataFrame, least: int = 1500) -> DataFrame:
    """df (xml, pdf as bytes, html; each may be null) with mode and text: the first of the three whose text is longer than `least`, else unavailable."""
    from folioflow.functions.text import html_main, xml_text
    from folioflow.sources.pdf import pdf_text

    forms = [("xml", xml_text("xml")), ("pdf", pdf_text("pdf")), ("html", F.regexp_replace(html_main("html"), r"\s+", " "))]
    texts = df.withColumns({f"_{m}": t for m, t in forms})
    fit = [F.when(F.length(f"_{m}") > least, F.struct(F.lit(m).alias("mode"), F.col(f"_{m}").alias("text"))) for m, _ in forms]
    none = F.struct(F.lit("unavailable").alias("mode"), F.lit(None).cast("string").alias("text"))
    return texts.withColumn("_r", F.coalesce(*fit, none)).select(*df.columns, "_r.mode", "_r.text")
