"""Bibliographic record sources: search-result CSV files and landed JSON from
search engines (Scopus entries, PubMed articles), mapped to record columns.

Multi-value fields (authors, affiliations, countries, keywords, source) are
arrays inside; they are joined with "|" only at the CSV edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from scriptorium.functions.dates import iso_date, year_prefix
from scriptorium.operators.merge import MULTI_SEPARATOR, blank_to_null, tag_source

# Fixed value: the column marking a Publish-or-Perish export.
POP_MARKER = "CitesPerAuthor"
REQUIRED_COLUMNS = ("doi", "title", "first_author", "publication", "authors")
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def require_columns(df: DataFrame, cols: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"The CSV file must contain the following columns: {', '.join(repr(c) for c in cols)}; missing {missing}")
    return df


def first_author(authors: Column) -> Column:
    """Text before the first comma of an author list."""
    return F.element_at(F.split(authors, ","), 1)


def map_pop_columns(raw: DataFrame) -> DataFrame:
    """Publish-or-Perish columns -> record columns (year as int, first author derived)."""
    return raw.select(
        F.col("Title").alias("title"),
        F.col("Authors").alias("authors"),
        first_author(F.col("Authors")).alias("first_author"),
        F.col("Source").alias("publication"),
        F.col("Type").alias("publication_type"),
        F.col("Year").cast("string").try_cast("int").alias("year"),
        F.col("Cites").cast("string").try_cast("long").alias("citations_count"),
        F.col("DOI").alias("doi"),
        F.col("Abstract").alias("abstract"),
        F.col("ISSN").alias("issn"),
    )


def typed_columns(raw: DataFrame) -> DataFrame:
    """``year`` and ``citations_count`` of a generic CSV as numbers, where it has them; other text gives NULL."""
    kinds = {"year": "int", "citations_count": "long"}
    return raw.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items() if c in raw.columns})


def read_search_csv(
    spark: SparkSession,
    path: str,
    fmt: str | None = "auto",
    source: str | None = None,
    query: str | None = None,
    works: DataFrame | None = None,
) -> DataFrame:
    """Read a search-result CSV (quoted multi-line fields) into record columns.

    ``fmt='auto'`` recognises a Publish-or-Perish export by its ``CitesPerAuthor``
    column.  Blank fields are NULL.  ``source`` defaults to ``external``, ``query``
    to ``""``.  With a ``works`` table, rows without DOI get one (see
    ``fill_missing_doi``; needs ``year``).
    """
    raw = spark.read.options(**CSV_OPTIONS).csv(path)
    if fmt == "auto":
        fmt = "PublishOrPerish" if POP_MARKER in raw.columns else None
    df = map_pop_columns(raw) if fmt == "PublishOrPerish" else typed_columns(raw)
    df = blank_to_null(require_columns(df))
    df = tag_source(df, source, query)
    if works is not None:
        df = fill_missing_doi(df, works)
    return df


def _norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def fill_missing_doi(df: DataFrame, works: DataFrame) -> DataFrame:
    """Give rows without DOI the DOI of the matching work, NULL if none.

    A work matches on normalised title, first author and year; among several
    the smallest DOI wins.  Works are reduced to one row per key before the
    join (map-side), so the join never multiplies rows.
    """
    key = [_norm(F.col("title")).alias("_t"), _norm(F.col("first_author")).alias("_a"), F.col("year").cast("int").alias("_y")]
    best = (
        works.select(_norm(F.col("title")).alias("_t"), _norm(F.col("author")).alias("_a"), F.col("year").cast("int").alias("_y"), F.col("DOI").alias("_doi"))
        .where(F.col("_doi").isNotNull())
        .groupBy("_t", "_a", "_y")
        .agg(F.min("_doi").alias("_doi"))
    )
    # rows with a DOI, or without a whole key, go around the join (null keys would all meet in one task)
    searched = df.select("*", *key).withColumn("_ask", F.expr("doi IS NULL AND _t IS NOT NULL AND _a IS NOT NULL AND _y IS NOT NULL"))
    asked = searched.where("_ask").join(best, ["_t", "_a", "_y"], "left").withColumn("doi", F.col("_doi"))
    return searched.where("NOT _ask").select(*df.columns).unionByName(asked.select(*df.columns))


def to_csv_edge(df: DataFrame) -> DataFrame:
    """Arrays joined by "|", DOI first."""
    cols = [F.array_join(F.col(f.name), MULTI_SEPARATOR).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema.fields]
    out = df.select(*cols)
    return out.select("doi", *[c for c in out.columns if c != "doi"]) if "doi" in out.columns else out


def write_results_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as CSV with ``doi`` as first column (quoted multi-line fields)."""
    to_csv_edge(df).write.options(**CSV_OPTIONS).mode(mode).csv(path)


# --- landed search-engine JSON ---------------------------------------------------

SCOPUS_ENTRY_SCHEMA = (
    "`prism:doi` string, `dc:title` string, `dc:creator` string, author array<struct<authname:string>>, "
    "`prism:publicationName` string, `prism:aggregationType` string, `prism:coverDate` string, "
    "`dc:identifier` string, `pubmed-id` string, `dc:description` string, authkeywords array<string>, "
    "`citedby-count` string, affiliation array<struct<affilname:string, `affiliation-country`:string>>"
)
PUBMED_ARTICLE_SCHEMA = (
    "doi string, title string, authors array<string>, journal string, publication_types map<string,string>, "
    "year string, history struct<accepted:string>, abstract string, keywords array<string>, "
    "author_list array<struct<affiliations:array<string>>>, pmid string, book string"
)


CORRUPT = "_corrupt_record"


def read_landed(spark: SparkSession, path: str, schema: str, fmt: str = "json", keep_corrupt: bool = False, **options) -> DataFrame:
    """Landed files with an explicit schema (no inference pass).

    ``keep_corrupt`` adds the column ``_corrupt_record`` with the text of rows
    that cannot be read (null on good rows), so they can be counted and set
    aside; without it such rows come as nulls, as Spark's readers give them.

    Spark's newer XML parser reads a file anew for each row it cannot read and
    gives the text of the whole file; the older one gives the row's own text.
    """
    if keep_corrupt:
        schema, options = f"{schema}, {CORRUPT} string", {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        if fmt == "xml":
            options = {"useLegacyXMLParser": "true", **options}
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def read_json_records(spark: SparkSession, path: str, schema: str, keep_corrupt: bool = False) -> DataFrame:
    """Landed JSON lines (see ``read_landed``)."""
    return read_landed(spark, path, schema, keep_corrupt=keep_corrupt)


def corrupt_report(df: DataFrame) -> DataFrame:
    """``status, n``: rows read and rows that could not be read.

    The values of every column are counted with them: a reader that is asked for
    fewer columns also finds fewer faults.
    """
    status = F.when(F.col(CORRUPT).isNotNull(), "corrupt").otherwise("read")
    values = F.array(*[F.count(F.col(f"`{c}`")) for c in df.columns])
    counted = df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), values.alias("_values"))
    return counted.where(F.array_max("_values") >= 0).select("status", "n")


def _set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def normalize_scopus(entries: DataFrame) -> DataFrame:
    """Scopus search entries -> records; entries lacking DOI, title or creator are dropped."""
    e = entries.where(F.col("`prism:doi`").isNotNull() & F.col("`dc:title`").isNotNull() & F.col("`dc:creator`").isNotNull())
    cover = F.col("`prism:coverDate`")
    affs = F.coalesce(F.col("affiliation"), F.array())
    return e.select(
        F.col("`prism:doi`").alias("doi"),
        F.col("`dc:title`").alias("title"),
        F.col("`dc:creator`").alias("first_author"),
        F.transform(F.coalesce(F.col("author"), F.array()), lambda a: a["authname"]).alias("authors"),
        F.coalesce(F.col("`prism:publicationName`"), F.lit("")).alias("publication"),
        F.coalesce(F.col("`prism:aggregationType`"), F.lit("")).alias("publication_type"),
        year_prefix(cover).alias("year"),
        F.coalesce(cover, F.lit("")).alias("date"),
        F.col("`dc:identifier`").alias("scopus_id"),
        F.coalesce(F.col("`pubmed-id`"), F.lit("")).alias("pmid"),
        F.coalesce(F.col("`dc:description`"), F.lit("")).alias("abstract"),
        F.coalesce(F.col("authkeywords"), F.array().cast("array<string>")).alias("keywords"),
        F.coalesce(F.col("`citedby-count`").try_cast("long"), F.lit(0).cast("long")).alias("citations_count"),
        _set(F.transform(affs, lambda a: F.coalesce(a["affilname"], F.lit("")))).alias("affiliation"),
        _set(F.transform(affs, lambda a: F.coalesce(a["affiliation-country"], F.lit("")))).alias("affiliation_country"),
    )


# Publication type of a book, and when no type is given.
BOOK_TYPE = "book"
OTHER_TYPE = "other"


def normalize_pubmed(articles: DataFrame) -> DataFrame:
    """PubMed articles -> records: first listed type (book if a book field exists),
    ISO accepted date, union of all authors' affiliations."""
    ptype = (
        F.when(F.col("book").isNotNull(), F.lit(BOOK_TYPE))
        .otherwise(F.coalesce(F.try_element_at(F.map_values("publication_types"), F.lit(1)), F.lit(OTHER_TYPE)))
    )
    affs = F.flatten(F.transform(F.coalesce(F.col("author_list"), F.array()), lambda a: F.coalesce(a["affiliations"], F.array().cast("array<string>"))))
    return articles.select(
        "doi",
        "title",
        F.try_element_at(F.col("authors"), F.lit(1)).alias("first_author"),
        F.coalesce(F.col("authors"), F.array().cast("array<string>")).alias("authors"),
        F.col("journal").alias("publication"),
        ptype.alias("publication_type"),
        F.col("year").try_cast("int").alias("year"),
        iso_date(F.try_to_date(F.col("history.accepted"))).alias("date"),
        F.col("pmid"),
        "abstract",
        F.coalesce(F.col("keywords"), F.array().cast("array<string>")).alias("keywords"),
        _set(affs).alias("affiliation"),
    )

