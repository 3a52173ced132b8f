"""Inputs of the registered queries, derived by Spark from the given test tables.

The test tables hold generic documents, conversations and TPC-H-like rows; the
bibliographic shapes the operators read (papers, sections, a reference library,
...) are derived from them here with column expressions only, so every query's
work grows with the tables.  Each rule below has a twin in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, in as many partitions as the session asks for (``tables.SCAN_PARTITIONS``)."""
    from scriptorium.sources.tables import SCAN_PARTITIONS, read_table

    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", partitions=int(wanted) if wanted else None)


def doc_year(doc_id: Column) -> Column:
    return (F.lit(2000) + doc_id % 25).cast("int")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def documents_with_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + ``year = 2000 + doc_id % 25``."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "lang", "source", doc_year(F.col("doc_id")).alias("year"))


# The three search engines in arrival order (priority 0, 1, 2).
ENGINES = ("scopus", "crossref", "pubmed")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliographic records as three engines would return them.

    One record per document; the engine is ``doc_id % 3`` (its arrival priority),
    the DOI is ``'10.1/' || md5(text)`` (so copies of a text collide and must be
    merged), missing every 7th; blanks are planted by other residues.
    """
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    blank_if = lambda cond, value: F.when(cond, F.lit("")).otherwise(value)
    return d.select(
        F.when(i % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("10.1/"), F.md5("text"))).alias("doi"),
        blank_if(i % 5 == 0, first_line(F.col("text"))).alias("title"),
        blank_if(i % 4 == 1, F.col("source")).alias("first_author"),
        F.concat_ws("|", F.col("source"), F.col("lang")).alias("authors"),
        blank_if(i % 6 == 0, F.col("lang")).alias("publication"),
        doc_year(i).alias("year"),
        F.col("text").alias("abstract"),
        F.element_at(F.array(*[F.lit(e) for e in ENGINES]), (i % 3 + 1).cast("int")).alias("source"),
        (i % 3).cast("int").alias("priority"),
        i.alias("seq"),
    )


# --- reference library -------------------------------------------------------

# Field dictionary, group libraries and collection names of the
# derived library.  Field ids follow the usual numbering of the desktop app.
LIBRARY_FIELDS = ((1, "title"), (2, "abstractNote"), (8, "date"), (13, "ISSN"), (59, "DOI"))
LIBRARY_GROUPS = ((2, "Shared Group"),)
COLLECTION_NAMES = ("reading", "screened", "archive")
LIBRARY_ROOT = "/data/library"
ATTACHMENT_BASE = 1_000_000_000


def _lpad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def library(spark: SparkSession, sf_dir: str):
    """A reference library derived from conversations (items) and documents (DOIs).

    * every conversation is an item (library 2 when ``conv_id % 3 = 2``, else 1);
      its title is the first line of turn 0, its abstract all its turns, its date is
      built from the id (``n.d.`` every 11th, ``Spring YYYY`` every 13th), and its
      DOI is the DOI of the document with the same id (missing every 5th);
    * every turn is an attachment item: user -> PDF, assistant -> HTML,
      system -> plain text; the path is missing when ``(conv_id + turn) % 6 = 5``;
    * collection ``(conv_id div 3) % 3`` of its library.
    """
    from scriptorium.sources.library import Library

    conv = table(spark, sf_dir, "conversations")
    docs = table(spark, sf_dir, "documents")
    cid = F.col("conv_id")
    lib_id = F.when(cid % 3 == 2, F.lit(2)).otherwise(F.lit(1)).cast("long")
    parents = conv.where(F.col("turn") == 0).select(
        (cid + 1).cast("long").alias("itemID"), F.concat(F.lit("P"), _lpad(cid, 7)).alias("key"), lib_id.alias("libraryID"), "conv_id", "text"
    )
    att_id = (F.lit(ATTACHMENT_BASE) + cid * 1000 + F.col("turn")).cast("long")
    attach = conv.select(
        att_id.alias("itemID"),
        F.concat(F.lit("A"), _lpad(cid, 7), F.lit("_"), F.col("turn").cast("string")).alias("key"),
        lib_id.alias("libraryID"),
        (cid + 1).cast("long").alias("parentItemID"),
        F.when(F.col("role") == "user", F.lit("application/pdf"))
        .when(F.col("role") == "assistant", F.lit("text/html"))
        .otherwise(F.lit("text/plain"))
        .alias("contentType"),
        F.when((cid + F.col("turn")) % 6 == 5, F.lit(None).cast("string"))
        .otherwise(
            F.concat(
                F.lit("storage:turn"),
                F.col("turn").cast("string"),
                F.when(F.col("role") == "user", F.lit(".pdf")).when(F.col("role") == "assistant", F.lit(".html")).otherwise(F.lit(".txt")),
            )
        )
        .alias("path"),
    )
    items = parents.select("itemID", "key", "libraryID").unionByName(attach.select("itemID", "key", "libraryID"))
    year = (F.lit(2000) + cid % 25).cast("string")
    date = (
        F.when(cid % 11 == 0, F.lit("n.d."))
        .when(cid % 13 == 0, F.concat(F.lit("Spring "), year))
        .otherwise(F.concat(year, F.lit("-"), _lpad(F.lit(1) + cid % 9, 2), F.lit("-15")))
    )
    title_v = parents.select("itemID", F.lit(1).cast("long").alias("fieldID"), first_line(F.col("text")).alias("value"))
    date_v = parents.select("itemID", F.lit(8).cast("long").alias("fieldID"), date.alias("value"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    abstract_v = conv.groupBy("conv_id").agg(F.array_join(turns, "\n").alias("value")).select(
        (cid + 1).cast("long").alias("itemID"), F.lit(2).cast("long").alias("fieldID"), "value"
    )
    doi_v = (
        parents.where(cid % 5 != 4)
        .join(docs.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("dtext")), "conv_id")
        .select("itemID", F.lit(59).cast("long").alias("fieldID"), F.concat(F.lit("10.1/"), F.md5("dtext")).alias("value"))
    )
    data = title_v.unionByName(date_v).unionByName(abstract_v).unionByName(doi_v).withColumn(
        "valueID", F.col("itemID") * 100 + F.col("fieldID")
    )
    spark_ = docs.sparkSession
    fields_df = spark_.createDataFrame(list(LIBRARY_FIELDS), "fieldID long, fieldName string")
    groups = spark_.createDataFrame(list(LIBRARY_GROUPS), "libraryID long, name string")
    colls = spark_.createDataFrame(
        [(lib * 10 + k, lib, name) for lib in (1, 2) for k, name in enumerate(COLLECTION_NAMES)],
        "collectionID long, libraryID long, collectionName string",
    )
    coll_items = parents.select(((F.col("libraryID") * 10) + F.floor(cid / 3) % 3).cast("long").alias("collectionID"), "itemID")
    return Library(
        items=items,
        itemData=data.select("itemID", "fieldID", "valueID"),
        itemDataValues=data.select("valueID", "value"),
        fieldsCombined=fields_df,
        collections=colls,
        collectionItems=coll_items,
        groups=groups,
        itemAttachments=attach.select("itemID", "parentItemID", "contentType", "path"),
    )


# --- sections ------------------------------------------------------------------

# Headings given to the derived sections.
SECTION_HEADS = (
    "Introduction",
    "Related work",
    "Materials and methods",
    "Experiments and results",
    "Discussion",
    "Conclusion and future work",
    "Appendix",
)
SUB_HEADS = ("Data", "Setup", "Analysis", "Details")


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed sections: every line of a document is a section (``pos`` = line number).

    Line ``pos`` is main section ``m = pos div 5`` (sub-section ``k = pos % 5``
    when ``k > 0``); the numbering scheme is ``doc_id % 4``:
    0 numbered (``1.``/``1.1``; ``1``/``1.1`` when ``doc_id % 8 = 0``; every 5th
    row unnumbered), 1 roman (``IV. Discussion``), 2 capitals (``RELATED work``),
    3 plain headings (main rows only).  Headings repeat every 7 main sections,
    so near-duplicate and repeated-key rules fire on long documents.
    """
    from scriptorium.functions.text import int_to_roman

    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    pos = F.col("pos")
    base = lines.select(
        "doc_id", "pos", "text",
        F.floor(pos / 5).alias("_m"), (pos % 5).alias("_k"), (F.col("doc_id") % 4).alias("_scheme"),
    )
    m, k, scheme, i = F.col("_m"), F.col("_k"), F.col("_scheme"), F.col("doc_id")
    named = base.select("*", _pick(SECTION_HEADS, m % 7).alias("_head"), F.when(k > 0, _pick(SUB_HEADS, k - 1)).alias("_sub"))
    head, sub = F.col("_head"), F.col("_sub")
    n_main = (m + 1).cast("string")
    num = F.when(
        scheme == 0,
        F.when(k == 0, F.concat(n_main, F.when(i % 8 == 0, F.lit("")).otherwise(F.lit("."))))
        .when(k == 4, F.lit(""))
        .otherwise(F.concat(n_main, F.lit("."), k.cast("string"))),
    ).otherwise(F.lit(""))
    first = F.substring_index(head, " ", 1)
    capital = F.when(m % 2 == 0, F.upper(head)).otherwise(F.concat(F.upper(first), F.expr("substring(_head, length(substring_index(_head, ' ', 1)) + 1)")))
    roman = F.when((scheme == 1) & (k == 0), F.concat(int_to_roman(m + 1), F.lit(". "), head))
    heading = (
        F.when(scheme == 0, F.when(k == 0, head).when(k == 4, F.lit("")).otherwise(sub))
        .when(scheme == 1, F.when(k == 0, roman).otherwise(sub))
        .when(scheme == 2, F.when(k == 0, capital).otherwise(sub))
        .otherwise(F.when(k == 0, head).otherwise(F.lit("")))
    )
    empty = F.array().cast("array<string>")
    return named.select(
        i.alias("item_key"),
        pos.cast("int").alias("pos"),
        heading.alias("heading"),
        num.alias("num"),
        "text",
        F.when(pos % 3 == 0, F.array(F.concat(F.lit("b"), pos.cast("string")))).otherwise(empty).alias("publication_refs"),
        F.when(k == 1, F.array(F.concat(F.lit("fig"), m.cast("string")))).otherwise(empty).alias("figure_refs"),
        F.when((k == 2) & (m % 2 == 1), F.array(F.concat(F.lit("tab"), m.cast("string")))).otherwise(empty).alias("table_refs"),
    )


def paper_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of papers built from ``part``: part ``p`` is table ``p % 2`` of paper ``p div 2``.

    Header row ``[Method|'', brand, size]``, then ``[name, price, size]``, then
    ``[type, '0.5']`` (ragged ``[type]`` when ``p % 7 = 0``); no cells when ``p % 11 = 0``.
    """
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pos = (k % 2).cast("int")
    header = F.array(F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("Method")), F.col("p_brand"), F.lit("size"))
    body = F.array(F.col("p_name"), F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"))
    last = F.when(k % 7 == 0, F.array(F.col("p_type"))).otherwise(F.array(F.col("p_type"), F.lit("0.5")))
    cells = F.when(k % 11 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(header, body, last))
    return p.select(
        F.floor(k / 2).alias("item_key"),
        pos.alias("pos"),
        F.concat(F.lit("Table "), (pos + 1).cast("string")).alias("label"),
        F.concat(F.lit("Table "), (pos + 1).cast("string"), F.lit(": "), F.col("p_name")).alias("caption"),
        F.concat(F.lit("tab"), k.cast("string")).alias("figure_id"),
        cells.alias("cells"),
    )


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of papers: every document line is a figure caption too; every third figure has no head."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    n = (F.col("line") + 1).cast("string")
    return lines.select(
        F.col("doc_id").alias("item_key"),
        F.col("line").cast("int").alias("pos"),
        F.when(F.col("line") % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("Figure "), n)).alias("label"),
        F.col("text").alias("caption"),
        F.lit("figure").alias("type"),
        F.concat(F.lit("fig"), F.col("line").cast("string")).alias("figure_id"),
    )


def tei_documents(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """TEI text per document built from the derived sections, tables and figures; of the papers in ``keys`` only, if given.

    Title = first line of the document; abstract = its second line ("" if none).
    Every seventh section stands in an annex wrapper (a div without namespace
    declaration); the back matter cites source and language, and the size of
    the document stands in a formula.
    """
    from scriptorium.sources.tei import build_tei

    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    papers_ = d.select(
        F.col("doc_id").alias("item_key"),
        F.element_at(lines, 1).alias("title"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("abstract"),
        F.array("source", "lang").alias("references"),
        F.array(F.concat(F.lit("n = "), F.col("n_chars").cast("string"))).alias("formulas"),
    )
    secs = sections(spark, sf_dir).withColumn("annex", F.col("pos") % 7 == 6)
    parts = (papers_, secs, tables(spark, sf_dir), figures(spark, sf_dir))
    if keys is not None:
        parts = (p.join(keys, "item_key", "left_semi") for p in parts)
    return build_tei(*parts, annex_col="annex")


def library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files present in library storage: attachments with a path, except when
    ``(conv_id + turn) % 4 = 1`` (those files are missing)."""
    conv = table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    ext = F.when(F.col("role") == "user", F.lit(".pdf")).when(F.col("role") == "assistant", F.lit(".html")).otherwise(F.lit(".txt"))
    key = F.concat(F.lit("A"), _lpad(cid, 7), F.lit("_"), turn.cast("string"))
    has_path = (cid + turn) % 6 != 5
    return conv.where(has_path & ((cid + turn) % 4 != 1)).select(
        F.concat(F.lit(LIBRARY_ROOT + "/storage/"), key, F.lit("/turn"), turn.cast("string"), ext).alias("path")
    )


def tei_by_path(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """TEI of each PDF attachment: a conversation's PDFs hold the TEI of the document with the same id.

    ``damaged``: it is missing where ``conv_id % 4 = 1`` and cut off where ``conv_id % 4 = 2``.
    """
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    cid, turn = F.col("conv_id"), F.col("turn")
    path = F.concat(F.lit(LIBRARY_ROOT + "/storage/A"), _lpad(cid, 7), F.lit("_"), turn.cast("string"), F.lit("/turn"), turn.cast("string"), F.lit(".pdf"))
    pdfs = conv.select(F.col("conv_id").alias("item_key"), path.alias("path"))
    found = pdfs.join(tei_documents(spark, sf_dir, pdfs.select("item_key").distinct()), "item_key")
    if damaged:
        cut = F.when(F.col("item_key") % 4 == 2, F.left("content", F.lit(100))).otherwise(F.col("content"))
        found = found.where(F.col("item_key") % 4 != 1).withColumn("content", cut)
    return found.select("path", "content")


# --- countries -------------------------------------------------------------------

# The affiliation country text of each nation key 0..24.
NATION_COUNTRIES = (
    "Hong Kong", "South Korea", "Ciudad de México, DF", "Atlantis", "Boston, USA",
    "Paris, France", "Montréal, Canada", "Berlin, Germany", "London", "Tokyo, Japan",
    "Isfahan Iran", "Durban South Africa", "Kolkata, West Bengal", "Saudia Arabia", "Zürich, Switzerland",
    "Algérie", "Lima, Peru", "china", "Brno, Czechia", "Cardiff, Wales",
    "P. O. Box Saudi Arabia", "Sydney, Australia", "Seoul", "Narnia", "U.S.A",
)


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers: key, ISO date text, and the affiliation countries of
    the customer's nation (plus a second nation for every third order)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    names = F.array(*[F.lit(x) for x in NATION_COUNTRIES])
    first = F.element_at(names, (F.col("c_nationkey") + 1).cast("int"))
    second = F.element_at(names, ((F.col("c_nationkey") + F.col("o_orderkey")) % 25 + 1).cast("int"))
    countries = F.when(F.col("o_orderkey") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.concat(F.lit("10.2/"), F.col("o_orderkey").cast("string")).alias("doi"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        countries.alias("affiliation_country"),
    )


# --- landed search results ---------------------------------------------------------


def _doc_doi(i: Column) -> Column:
    return F.when(i % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("10.1/"), F.md5("text")))


def pop_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a Publish-or-Perish export (DOI missing every 7th row)."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        first_line(F.col("text")).alias("Title"),
        F.concat(F.col("source"), F.lit(", "), F.col("lang")).alias("Authors"),
        F.col("lang").alias("Source"),
        F.when(i % 2 == 0, F.lit("Journal")).otherwise(F.lit("Book")).alias("Type"),
        doc_year(i).alias("Year"),
        _doc_doi(i).alias("DOI"),
        F.col("text").alias("Abstract"),
        _lpad(i, 8).alias("ISSN"),
        (F.col("n_chars") % 97).alias("Cites"),
        (F.col("n_chars") / 2.0).alias("CitesPerAuthor"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bibliographic works table (every second document): title, author, publication, year, DOI."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == 0)
    return d.select(
        first_line(F.col("text")).alias("title"),
        F.col("source").alias("author"),
        F.col("lang").alias("publication"),
        doc_year(F.col("doc_id")).alias("year"),
        F.concat(F.lit("10.1/"), F.md5("text")).alias("DOI"),
    )


def cited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records cited from memory, none with a DOI.

    By ``doc_id % 4`` the title is as it is, has a subtitle, has its first word
    misspelt, or lacks its last word; authors come with a surname, every fifth
    publication is missing, every third year is one too late.
    """
    d = table(spark, sf_dir, "documents")
    i, line = F.col("doc_id"), first_line(F.col("text"))
    title = (
        F.when(i % 4 == 1, F.concat(line, F.lit(": a view from "), F.col("source"), F.lit(" and beyond")))
        .when(i % 4 == 2, F.concat(F.lit("q"), line)).when(i % 4 == 3, F.regexp_replace(line, "[^ ]+$", "")).otherwise(line)
    )
    return d.select(
        F.lit(None).cast("string").alias("doi"), title.alias("title"), F.concat(F.col("source"), F.lit(" Smith")).alias("first_author"),
        F.when(i % 5 != 0, F.col("lang")).alias("publication"), (doc_year(i) + F.when(i % 3 == 0, 1).otherwise(0)).cast("int").alias("year"),
        i.alias("seq"),
    )


def _docs_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    c = table(spark, sf_dir, "customer")
    return d.join(c, d.doc_id == c.c_custkey, "left")


def scopus_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopus search entries as JSON text (every document + its customer)."""
    j = _docs_customers(spark, sf_dir)
    i = F.col("doc_id")
    line = first_line(F.col("text"))
    country = F.element_at(F.array(*[F.lit(x) for x in NATION_COUNTRIES]), (F.col("c_nationkey") + 1).cast("int"))
    aff = F.when(
        F.col("c_custkey").isNotNull(),
        F.array(
            F.struct(F.col("c_name").alias("affilname"), country.alias("affiliation-country")),
            F.struct(F.col("c_mktsegment").alias("affilname"), F.lit(None).cast("string").alias("affiliation-country")),
        ),
    )
    entry = F.struct(
        _doc_doi(i).alias("prism:doi"),
        line.alias("dc:title"),
        F.when(i % 11 != 0, F.col("source")).alias("dc:creator"),
        F.array(F.struct(F.col("source").alias("authname")), F.struct(F.col("lang").alias("authname"))).alias("author"),
        F.col("lang").alias("prism:publicationName"),
        F.when(i % 2 == 0, F.lit("Journal")).alias("prism:aggregationType"),
        F.when(i % 9 != 0, F.concat(doc_year(i).cast("string"), F.lit("-0"), (F.lit(1) + i % 9).cast("string"), F.lit("-01"))).alias("prism:coverDate"),
        F.concat(F.lit("SCOPUS_ID:"), i.cast("string")).alias("dc:identifier"),
        F.when(i % 2 == 0, i.cast("string")).alias("pubmed-id"),
        F.col("text").alias("dc:description"),
        F.split(F.lower(line), " ").alias("authkeywords"),
        (F.col("n_chars") % 50).cast("string").alias("citedby-count"),
        aff.alias("affiliation"),
    )
    return j.select(F.to_json(entry).alias("value"))


def pubmed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PubMed articles as JSON text (every document + its customer)."""
    j = _docs_customers(spark, sf_dir)
    i = F.col("doc_id")
    line = first_line(F.col("text"))
    types = F.when(i % 4 != 3, F.create_map(F.lit("D016428"), F.lit("Journal Article"), F.lit("D016454"), F.lit("Review")))
    affs = F.when(
        F.col("c_custkey").isNotNull(),
        F.array(
            F.struct(F.array(F.col("c_name"), F.concat(F.lit("Dept "), F.col("c_mktsegment"))).alias("affiliations")),
            F.struct(F.array(F.col("c_name")).alias("affiliations")),
        ),
    ).otherwise(F.array().cast("array<struct<affiliations:array<string>>>"))
    art = F.struct(
        _doc_doi(i).alias("doi"),
        line.alias("title"),
        F.array(F.col("source"), F.col("lang")).alias("authors"),
        F.col("lang").alias("journal"),
        types.alias("publication_types"),
        doc_year(i).cast("string").alias("year"),
        F.struct(F.when(i % 5 != 0, F.concat(doc_year(i).cast("string"), F.lit("-0"), (F.lit(1) + i % 9).cast("string"), F.lit("-15"))).alias("accepted")).alias("history"),
        F.col("text").alias("abstract"),
        F.split(F.lower(line), " ").alias("keywords"),
        affs.alias("author_list"),
        i.cast("string").alias("pmid"),
        F.when(i % 10 == 5, F.lit("Handbook")).alias("book"),
    )
    return j.select(F.to_json(art).alias("value"))


# --- screening model -------------------------------------------------------------


def rule_model(messages: list[dict]) -> str:
    """A deterministic stand-in for a text model: answers from the user paper's words.

    ``n`` = number of words of the abstract; abstracts of fewer than 5 words
    raise, to exercise per-row error capture.
    """
    paper = next(m["content"] for m in reversed(messages) if m["role"] == "user" and m["content"].startswith("USER PAPER:"))
    abstract = paper.split("\n", 1)[1] if "\n" in paper else ""
    n = len([w for w in abstract.split(" ") if w])
    if n < 5:
        raise ValueError("abstract too short")
    question = messages[-1]["content"].split("\n", 1)[0]
    pad = f" {abstract} "
    if question.startswith("Which language"):
        if " the " in pad:
            return "English"
        return "German, mostly" if (" und " in pad or " der " in pad) else "Spanish or French."
    if question.startswith("Which type of images"):
        return ("It uses color fundus photographs.", "OCT or OCTA", '"Other".')[n % 3]
    if question.startswith("Which sentence"):
        return ("novel segmentation method", "A novel artery and vein classification method.", "review other research papers", "Hmm.")[n % 4]
    if question.startswith("Which structure"):
        return "retinal vessels" if n % 2 == 0 else "The optic disc"
    return "other"


def rule_model_factory():
    return lambda prompts: [rule_model(messages) for messages in prompts]
