"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator group.

Every query reads the given tables (through ``fixtures``) and runs over them
whole.  Doubles are rounded to 6 digits at the output so that the SQL oracle
(DuckDB) and Spark agree despite different summation orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import WORD_KEY_LEN
from scriptorium.operators import lexical, matching, merge, search, textindex
from scriptorium.operators import library as libops
from scriptorium.operators import sections as secops
from scriptorium.operators import segments as segops
from scriptorium.plans import fixtures as fx
from scriptorium.operators import export as expops
from scriptorium.operators import geo
from scriptorium.operators import screening as scr
from scriptorium.sources import corpus, records, tei
from scriptorium.session import scratch_dir
from scriptorium.streaming import incremental

QueryFn = Callable[[SparkSession, str], DataFrame]

# The words of the registered term-frequency queries.
TF_WORDS = ("the", "license", "und", "que", "api[_ ]?key|secret|password")
TF_LABELLED = {"french_article": " la | le "}


def _r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


def q_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + A6 + W10 + W11 + O2: yearly share of documents per word, smoothed, ordered."""
    docs = fx.documents_with_year(spark, sf_dir)
    s = lexical.freq_series(docs, TF_WORDS, column="text", labelled=TF_LABELLED)
    return s.select("word", "label", "year", _r6("freq"), _r6("smoothed"), _r6("chrono_score"), "chrono_rank")


# The word list of the token-based frequency query.
TOKEN_WORDS = ("the", "and", "of", "und", "der", "die", "que", "el", "los", "le", "la", "les", "des",
               "license", "licensed", "secret", "password", "mit", "apache", "copyright")


def q_token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 for long word lists: share of documents per year containing each whole token."""
    docs = fx.documents_with_year(spark, sf_dir)
    return lexical.token_frequency(docs, TOKEN_WORDS, column="text").select("year", "word", "n_docs", _r6("freq"))


def q_freq_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall maximum of the frequency table."""
    docs = fx.documents_with_year(spark, sf_dir)
    tf = lexical.term_frequency(docs, TF_WORDS, column="text", labelled=TF_LABELLED)
    return lexical.freq_max(tf).select(_r6("freq_max"))


# --- merge and search -------------------------------------------------------

PAPER_OUT = ("doi", "title", "first_author", "authors", "publication", "year", "abstract", "source")


def _csv_edge(df: DataFrame, cols=PAPER_OUT) -> DataFrame:
    """Arrays joined by "|", NULL -> "" (the reference's output convention)."""
    return merge.null_to_blank(merge.join_multi(df)).select(*cols)


def q_merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A2 + P4 + O1: merge the records of all engines by DOI (one scan, one shuffle)."""
    return _csv_edge(merge.merge_duplicates(fx.papers(spark, sf_dir)))


def q_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 + U3: three engines stacked in arrival order (CrossRef without abstracts), then merged."""
    p = fx.papers(spark, sf_dir)
    frames = [
        p.where(F.col("priority") == 0).drop("priority"),
        p.where(F.col("priority") == 1).drop("priority", "abstract"),
        p.where(F.col("priority") == 2).drop("priority"),
    ]
    return _csv_edge(merge.merge_duplicates(merge.union_sources(frames)))


def q_append_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + U2: first load (even seq) stored as is, second load (odd seq) merged in, old first."""
    p = fx.papers(spark, sf_dir)
    first = merge.append_results(None, p.where(F.col("seq") % 2 == 0))
    both = merge.append_results(first, p.where(F.col("seq") % 2 == 1))
    return _csv_edge(both)


def q_search_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 + P7 + W9 + A1: default engines, all terms, 2003-2018, 5 per engine and year, merged."""
    hits = search.search_papers(fx.papers(spark, sf_dir), "the of", 2003, 2018, max_per_year=5)
    return _csv_edge(merge.merge_duplicates(hits.drop("period")), ("doi", "title", "first_author", "year", "source", "query"))


def q_search_papers_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index that the papers were added to in two parts."""
    root, p = scratch_dir(spark, "papers-index"), fx.papers(spark, sf_dir)
    for k in range(2):
        textindex.add_records(p.where(F.col("seq") % 2 == k), root, ["title", "abstract"])
    hits = textindex.search_papers(spark, root, "the of", min_year=2003, max_year=2018, max_per_year=5)
    return _csv_edge(merge.merge_duplicates(hits.drop("period")), ("doi", "title", "first_author", "year", "source", "query"))


def q_term_frequency_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + F11: the flagship series, each pattern put only to texts that hold its literals."""
    root = scratch_dir(spark, "terms-index")
    textindex.add_records(fx.documents_with_year(spark, sf_dir).select("doc_id", "year", "text"), root, ["text"])
    s = lexical.series_of(textindex.term_frequency(spark, root, TF_WORDS, labelled=TF_LABELLED))
    return s.select("word", "label", "year", _r6("freq"), _r6("smoothed"), _r6("chrono_score"), "chrono_rank")


def q_search_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 + P9 + U1 + U3 + A1 + A3: one scan of all engines merged into the records of an earlier one."""
    p = fx.papers(spark, sf_dir)
    earlier = merge.merge_duplicates(p.where(F.col("seq") % 4 == 0))
    known = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"))
    frames = {e: p.where(F.col("source") == e).drop("priority") for e in fx.ENGINES}
    return _csv_edge(search.search_scan(frames, "scan", known, "seq", earlier), (*PAPER_OUT, "query"))


def q_cap_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 orders of every year (exact, skew-safe two-phase top-n)."""
    o = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice", F.year("o_orderdate").alias("year")
    )
    capped = search.cap_per_year(o, 50, order_cols=("o_orderdate", "o_orderkey"))
    return capped.select("o_orderkey", "year", F.round("o_totalprice", 2).alias("o_totalprice"))


def q_distinct_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: first record per non-blank title in arrival order."""
    p = fx.papers(spark, sf_dir).where(F.col("title") != "").select("title", "doi", "year", "source", "priority", "seq")
    return merge.distinct_titles(p).select("title", "doi", "year", "source", "seq")


def q_exclude_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose id another engine already gave (here: labelled ids) are skipped."""
    p = fx.papers(spark, sf_dir)
    known = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"))
    return search.exclude_keys(p, known, "seq").select("seq", "doi", "year")


def q_filter_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: records whose DOI is in a list (DOIs of the good-quality labelled documents)."""
    p = fx.papers(spark, sf_dir)
    good = fx.table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    docs = fx.table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi")
    dois = docs.select(F.concat(F.lit("10.1/"), F.md5("text")).alias("doi"))
    return search.filter_keys(p, dois, "doi").select("doi", "seq", "year", "source")


def q_year_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search periods per document source (closed range) and per language (open range)."""
    d = fx.documents_with_year(spark, sf_dir)
    closed = d.groupBy(F.col("source").alias("key")).agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"))
    open_ = d.groupBy(F.col("lang").alias("key")).agg(F.min("year").alias("min_year")).withColumn(
        "max_year", F.lit(None).cast("int")
    )
    return search.year_periods(closed.unionByName(open_)).select("key", "since", "until", "label")


# --- reference library ------------------------------------------------------


def q_fetch_item_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J12: the title of every item of the default library."""
    return libops.fetch_item_field(fx.library(spark, sf_dir), "title")


def q_fetch_item_field_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + J12: DOIs of the items of one collection of a named group library."""
    return libops.fetch_item_field(fx.library(spark, sf_dir), "DOI", library="Shared Group", collection="screened")


def q_fetch_item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + F3: doi, title, abstract and year side by side (one scan + pivot)."""
    return libops.fetch_item_fields(fx.library(spark, sf_dir), ["doi", "title", "abstract", "year"])


def q_list_local_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + W2 + F9 + F10: attachments with storage paths, PDF preferred (documented rule)."""
    return libops.list_local_path(fx.library(spark, sf_dir), fx.LIBRARY_ROOT, prefer="pdf")


def q_list_local_path_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + W1 + W2: HTML preferred, the code's rule (any item with several attachments)."""
    return libops.list_local_path(fx.library(spark, sf_dir), fx.LIBRARY_ROOT, prefer="html", strict=True, library="Shared Group")


def _paper_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.papers(spark, sf_dir).select("doi").where(F.col("doi").isNotNull())


def q_has_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is each searched DOI already in the library (any field, any library)."""
    return libops.has_doi(fx.library(spark, sf_dir), _paper_dois(spark, sf_dir))


def q_has_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content type of a local attachment for each searched DOI."""
    return libops.has_local(fx.library(spark, sf_dir), _paper_dois(spark, sf_dir))


def q_missing_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 + O3: the work list of DOIs not yet in the library."""
    lib = fx.library(spark, sf_dir)
    known = libops.fetch_item_field(lib, "DOI").select(F.col("DOI").alias("doi"))
    known = known.unionByName(libops.fetch_item_field(lib, "DOI", library="Shared Group").select(F.col("DOI").alias("doi")))
    return search.missing_dois(_paper_dois(spark, sf_dir), known, seed=7)


# --- sections ---------------------------------------------------------------


def _refs_joined(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(c, "|").alias(c) if c in secops.REF_COLS else F.col(c) for c in df.columns])


def q_flag_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose (heading, num) occurs more than once in their paper."""
    s = secops.flag_duplicates(fx.sections(spark, sf_dir).repartition("item_key"))
    return s.select("item_key", "pos", "is_duplicated")


def q_drop_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 + F12: near-duplicate sections removed (longest of a group kept)."""
    s = secops.drop_near_duplicates(fx.sections(spark, sf_dir).repartition("item_key"), n_word_chars=WORD_KEY_LEN)
    return s.select("item_key", "pos", "heading", "num")


def q_drop_near_duplicates_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 + F12 on whole texts: near-duplicates are sections whose word characters are all equal."""
    s = secops.drop_near_duplicates(fx.sections(spark, sf_dir).repartition("item_key"), n_word_chars=None)
    return s.select("item_key", "pos", "heading", "num")


def q_classify_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3-W8 + A10-A12 + F6 + F13 + F17 + F18: the whole section pipeline."""
    out = secops.classify_sections(fx.sections(spark, sf_dir))
    return _refs_joined(out.select("item_key", "sec_idx", "heading", "num", "text", *secops.REF_COLS, "type"))


def q_merge_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of each paper merged under its first heading."""
    out = secops.merge_section_list(fx.sections(spark, sf_dir))
    return _refs_joined(out.select("item_key", "heading", "num", "text", *secops.REF_COLS))


def q_text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + F14-F17 + W12: per paper, section texts by class, table captions and headings, figure captions."""
    classified = secops.classify_sections(fx.sections(spark, sf_dir))
    return segops.text_segments(fx.paper_keys(spark, sf_dir), classified, fx.tables(spark, sf_dir), fx.figures(spark, sf_dir))


def q_pretty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the human-readable dump of each paper's classified sections."""
    return secops.pretty_text(secops.classify_sections(fx.sections(spark, sf_dir)))


# --- TEI ------------------------------------------------------------------------


def _shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tei.shred_tei(fx.tei_documents(spark, sf_dir))


def q_shred_tei_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + S11: title, abstract and child counts of every shredded TEI paper."""
    s = _shredded(spark, sf_dir)
    return s.select(
        "item_key", "title", "abstract",
        F.size("sections").alias("n_sections"), F.size("tables").alias("n_tables"), F.size("figures").alias("n_figures"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def q_shred_tei_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + P15: sections of the shredded TEI (divs with neither heading nor text are skipped)."""
    return _refs_joined(tei.tei_sections(_shredded(spark, sf_dir)))


def q_shred_tei_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the shredded TEI with their cells (rows joined by ';', cells by '|')."""
    t = tei.tei_tables(_shredded(spark, sf_dir))
    cells = F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), ";")
    return t.select("item_key", "pos", "label", "caption", "figure_id", cells.alias("cells"))


def q_shred_tei_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the shredded TEI (caption = all text of the figure element)."""
    return tei.tei_figures(_shredded(spark, sf_dir))


# --- corpus export --------------------------------------------------------------


def _export(spark: SparkSession, sf_dir: str, out: str, damaged: bool = False, overwrite: bool = False) -> DataFrame:
    return expops.export_parsed(
        spark, fx.library(spark, sf_dir), fx.tei_by_path(spark, sf_dir, damaged), out, fx.LIBRARY_ROOT,
        fx.library_listing(spark, sf_dir), overwrite=overwrite,
    )


def _exported(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    years = libops.fetch_item_fields(fx.library(spark, sf_dir), ["year"]).withColumnRenamed("zoteroID", "item_key")
    return corpus.read_corpus(spark, out).join(years, "item_key")


def q_export_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S8 + S9 + F22 + J11 + P11 + P12: export library papers as XML, read the corpus back, add the year."""
    out = scratch_dir(spark, "corpus")
    _export(spark, sf_dir, out)
    return _exported(spark, sf_dir, out)


def q_export_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exporting again with ``overwrite`` replaces the papers; each key stays once."""
    out = scratch_dir(spark, "corpus")
    _export(spark, sf_dir, out)
    _export(spark, sf_dir, out, overwrite=True)
    return _exported(spark, sf_dir, out)


def q_export_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + A13: papers without TEI, or with TEI that is cut off, are reported as failed."""
    return _export(spark, sf_dir, scratch_dir(spark, "corpus"), damaged=True)


def q_export_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + J8: the papers that failed in a first run are exported by the next one; each key is there once."""
    out = scratch_dir(spark, "corpus")
    _export(spark, sf_dir, out, damaged=True)
    _export(spark, sf_dir, out)
    return _exported(spark, sf_dir, out)


def q_export_after_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S8 + J8: a flat corpus folder (every document) that exports add to and write over; every paper stays."""
    out = scratch_dir(spark, "corpus")
    corpus.write_corpus(_corpus_rows(spark, sf_dir), out)
    _export(spark, sf_dir, out)
    _export(spark, sf_dir, out, overwrite=True)
    return corpus.read_corpus(spark, out)


def q_exported_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + S9: the classified sections of exported papers with their refs, read back from the corpus."""
    out = scratch_dir(spark, "corpus")
    _export(spark, sf_dir, out)
    papers = corpus.papers_from_xml(corpus.read_corpus_raw(spark, out))
    s = papers.select("item_key", F.explode("sections").alias("s")).select("item_key", "s.*")
    return _refs_joined(s.select("item_key", "pos", "heading", "num", "type", *secops.REF_COLS))


def q_export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 + A13: exporting the same input twice; the second run exports nothing and skips all."""
    out = scratch_dir(spark, "corpus")
    _export(spark, sf_dir, out)
    return _export(spark, sf_dir, out)


# --- countries and terms ----------------------------------------------------------


def q_publications_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + F2 + A16: distinct papers per ISO country and year (orders as papers)."""
    return geo.publications_by_country(fx.order_records(spark, sf_dir))


def q_unknown_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """affiliation texts no country rule recognises, counted."""
    return geo.unknown_countries(fx.order_records(spark, sf_dir))


def q_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 + O6: the 20 most frequent terms of each language (word-cloud input)."""
    docs = fx.table(spark, sf_dir, "documents")
    counts = lexical.term_counts(docs, "text", ["lang"])
    return lexical.top_terms(counts, 20, ["lang"]).select("lang", "term", "n", "term_rank")


def q_heavy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 + O6: the 20 most frequent terms of each language, found by sketches and counted exactly."""
    docs = fx.table(spark, sf_dir, "documents")
    return lexical.heavy_terms(docs, 20, "text", ["lang"]).select("lang", "term", "n", "term_rank")


# --- landed search results ---------------------------------------------------------

RECORD_OUT = ("doi", "title", "first_author", "authors", "publication", "publication_type", "year",
              "citations_count", "abstract", "issn", "source", "query")


def q_import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P1-P3 + P5 + F7 + F8 + J9: a Publish-or-Perish CSV written, read back, DOIs filled from works."""
    path = scratch_dir(spark, "pop-csv")
    (fx.pop_export(spark, sf_dir).write.options(**records.CSV_OPTIONS)
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").mode("overwrite").csv(path))
    df = records.read_search_csv(spark, path, source="pop", query="imported", works=fx.works(spark, sf_dir))
    return df.select(*RECORD_OUT)


def q_best_match_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with subtitles and misspelt titles find their works by similarity, the best one wins."""
    filled = matching.fill_best_doi(fx.cited_records(spark, sf_dir), fx.works(spark, sf_dir))
    return filled.select("seq", "title", "doi", "match_score")


def q_import_generic_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P5: a CSV with the record columns already in place; year and citations become numbers."""
    path = scratch_dir(spark, "generic-csv")
    p = fx.papers(spark, sf_dir)
    year = F.when(F.col("seq") % 10 == 3, "in press").otherwise(F.col("year").cast("string"))
    rows = p.select("doi", "title", "first_author", "publication", "authors", year.alias("year"), (F.col("seq") % 31).alias("citations_count"))
    rows.write.options(**records.CSV_OPTIONS).mode("overwrite").csv(path)
    df = records.read_search_csv(spark, path, source="generic")
    return df.select("doi", "title", "first_author", "publication", "authors", "year", "citations_count", "source")


def q_corrupt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-S3 + S9: rows that cannot be read are kept apart and counted, in JSON, CSV and XML files."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    bad = F.col("doc_id") % 5 == 0
    json = F.when(bad, F.concat(F.lit('{"doc_id": "'), F.col("doc_id"), F.lit('", "lang"'))).otherwise(F.to_json(F.struct("doc_id", "lang")))
    csv = F.when(bad, F.concat(F.lit("x"), F.col("doc_id"), F.lit(",b"))).otherwise(F.concat_ws(",", "doc_id", "lang"))
    xml = scratch_dir(spark, "corrupt-xml")
    number = F.when(bad, "one").otherwise(F.col("doc_id").cast("string"))
    d.select(number.alias("doc_id"), "lang").write.format("xml").option("rowTag", "doc").save(xml)
    paths = {fmt: _land(spark, d.select(line.alias("value")), f"corrupt-{fmt}") for fmt, line in (("json", json), ("csv", csv))}
    out = None
    for fmt, path, options in (("json", paths["json"], {}), ("csv", paths["csv"], {}), ("xml", xml, {"rowTag": "doc"})):
        read = records.read_landed(spark, path, "doc_id long, lang string", fmt, keep_corrupt=True, **options)
        report = records.corrupt_report(read).withColumn("format", F.lit(fmt))
        out = report if out is None else out.unionByName(report)
    return out


def q_results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + O1: merged results exported as CSV (doi first, multi-values joined) and read back as text."""
    path = scratch_dir(spark, "results-csv")
    merged = merge.merge_duplicates(fx.papers(spark, sf_dir)).select(*[c for c in PAPER_OUT if c != "doi"], "doi")
    records.write_results_csv(merge.order_results(merged), path, mode="overwrite")
    back = spark.read.options(**records.CSV_OPTIONS).csv(path)
    return back.withColumn("first_column", F.lit(back.columns[0]))


def _land(spark: SparkSession, text_df: DataFrame, name: str) -> str:
    path = scratch_dir(spark, name)
    text_df.write.mode("overwrite").text(path)
    return path


def q_normalize_scopus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + F4 + F24 + A8: landed Scopus entries (JSON lines) to records."""
    path = _land(spark, fx.scopus_json(spark, sf_dir), "scopus-json")
    recs = records.normalize_scopus(records.read_json_records(spark, path, records.SCOPUS_ENTRY_SCHEMA))
    return records.to_csv_edge(recs)


def q_normalize_pubmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + F5 + F25 + A8: landed PubMed articles (JSON lines) to records."""
    path = _land(spark, fx.pubmed_json(spark, sf_dir), "pubmed-json")
    recs = records.normalize_pubmed(records.read_json_records(spark, path, records.PUBMED_ARTICLE_SCHEMA))
    return records.to_csv_edge(recs)


# --- screening ---------------------------------------------------------------------

SCREEN_OUT = ("doi", "title", *scr.ANSWER_COLUMNS, *scr.FLAG_COLUMNS, "error")


def _articles(spark: SparkSession, sf_dir: str, collection: str | None = None) -> DataFrame:
    """J4 + P13 + A4: doi, title and abstract of library items, complete rows, one per title."""
    lib = fx.library(spark, sf_dir)
    arts = libops.fetch_item_fields(lib, ["doi", "title", "abstract"], collection=collection).na.drop(subset=["doi", "title", "abstract"])
    return merge.distinct_titles(arts, order_cols=("zoteroID",))


def q_build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the user-paper message of every article (title + whole abstract)."""
    return scr.build_prompt(_articles(spark, sf_dir)).select("doi", "user_paper")


def q_build_prompt_300(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + O4: the user-paper message with the last 300 words of the abstract."""
    return scr.build_prompt(_articles(spark, sf_dir), n_words=300).select("doi", "user_paper")


FEW_SHOT = (
    scr.example_dialogue(1, "A first paper", "About roads.", [("language", "English"), ("image", "other")]),
    scr.example_dialogue(2, "Vessels", "Eyes.", [("image", "color fundus"), ("structure", "retinal vessels")]),
)


def q_few_shot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the whole prompt of the contribution question, two example dialogues included."""
    messages = scr.prompt_messages(scr.BY_COLUMN["contribution"].message(), few_shot=FEW_SHOT)
    shown = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return _articles(spark, sf_dir).select("doi", F.size(messages).alias("n_messages"), shown.alias("prompt"))


def q_answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M2 + M4: the language question as a prompt column, answered by the model per row."""
    arts = _articles(spark, sf_dir)
    asked = arts.select("doi", scr.prompt_messages(scr.BY_COLUMN["language"].message()).alias("messages"))
    return scr.answer_prompts(asked, fx.rule_model_factory).select(
        "doi", F.size("messages").alias("n_messages"), "response", "error"
    )


def _read_answers(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.options(**records.CSV_OPTIONS).csv(path)
    for c in scr.FLAG_COLUMNS:
        df = df.withColumn(c, F.col(c).try_cast("boolean"))
    return df


def q_screen_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2-M4 + F23 + J10 + S10 + P14: screen one collection, save, then the whole
    library resuming from the saved answers (only pending articles reach the model)."""
    first = scr.analyse_abstracts(_articles(spark, sf_dir, collection="reading"), None, fx.rule_model_factory)
    p1 = scratch_dir(spark, "screening")
    first.select(*SCREEN_OUT).write.options(**records.CSV_OPTIONS).mode("overwrite").csv(p1)
    second = scr.analyse_abstracts(_articles(spark, sf_dir), _read_answers(spark, p1), fx.rule_model_factory)
    p2 = scratch_dir(spark, "screening")
    second.select(*SCREEN_OUT).write.options(**records.CSV_OPTIONS).mode("overwrite").csv(p2)
    return _read_answers(spark, p2).select(*SCREEN_OUT)


# --- streaming ---------------------------------------------------------------------

PAPER_SCHEMA = (
    "doi string, title string, first_author string, authors string, publication string, year int, "
    "abstract string, source string, priority int, seq long"
)


def _corpus_rows(spark: SparkSession, sf_dir: str, part: int | None = None, parts: int = 1) -> DataFrame:
    """Corpus rows of every document (sections classified, segments built), or of those with ``doc_id % parts = part``."""

    def taken(df: DataFrame, key: str = "item_key") -> DataFrame:
        return df if part is None else df.where(F.col(key) % parts == part)

    d = taken(fx.table(spark, sf_dir, "documents"), "doc_id")
    lines = F.split("text", "\n")
    meta = d.select(
        F.col("doc_id").alias("item_key"), F.col("doc_id").cast("string").alias("zoteroID"),
        F.concat(F.lit("10.1/"), F.md5("text")).alias("doi"), F.element_at(lines, 1).alias("title"),
        F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
    )
    none = F.array().cast
    heads = d.select(
        F.col("doc_id").alias("item_key"), F.element_at(lines, 1).alias("title"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("abstract"),
        none(f"array<{tei.TABLE_STRUCT}>").alias("tables"), none(f"array<{tei.FIGURE_STRUCT}>").alias("figures"),
        none("array<string>").alias("references"), none("array<string>").alias("formulas"),
    )
    keys, secs, tabs, figs = (taken(f(spark, sf_dir)) for f in (fx.paper_keys, fx.sections, fx.tables, fx.figures))
    classified = secops.classify_sections(secs)
    return corpus.paper_rows(meta, heads, classified, segops.text_segments(keys, classified, tabs, figs))


def q_stream_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus files landing in three rounds, each picked up by an availableNow run."""
    src, sink, ckpt = scratch_dir(spark, "corpus-src"), scratch_dir(spark, "corpus-sink"), scratch_dir(spark, "corpus-ckpt")
    for k in range(3):
        corpus.write_corpus(_corpus_rows(spark, sf_dir, k, 3), src)
        incremental.stream_corpus(spark, src, sink, ckpt).awaitTermination()
    return spark.read.parquet(sink)


def q_stream_append_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + A3: each engine's records land, then an availableNow run merges them into the results."""
    land, out, ckpt = scratch_dir(spark, "records-land"), scratch_dir(spark, "records-out"), scratch_dir(spark, "records-ckpt")
    p = fx.papers(spark, sf_dir)
    for k in range(len(fx.ENGINES)):
        p.where(F.col("priority") == k).write.mode("append").json(land)
        incremental.stream_append_results(spark, land, PAPER_SCHEMA, out, ckpt).awaitTermination()
    return _csv_edge(incremental.read_results(spark, out))


def q_stream_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + A5: documents land in three rounds; their term counts are added up and give the flagship series."""
    land, out, ckpt = (scratch_dir(spark, f"terms-{name}") for name in ("land", "out", "ckpt"))
    docs = fx.documents_with_year(spark, sf_dir).select("doc_id", "year", "text")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).write.mode("append").parquet(land)
        stream = spark.readStream.schema(docs.schema).parquet(land)
        incremental.stream_term_counts(spark, stream, out, ckpt, TF_WORDS, TF_LABELLED, column="text").awaitTermination()
    s = lexical.series_of(incremental.read_term_frequency(spark, out))
    return s.select("word", "label", "year", _r6("freq"), _r6("smoothed"), _r6("chrono_score"), "chrono_rank")


# --- storage round trips -------------------------------------------------------------


def q_library_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library tables saved as Parquet and opened again; doi/title/year of the group library."""
    from scriptorium.sources.library import load_library, save_library

    path = scratch_dir(spark, "library")
    save_library(fx.library(spark, sf_dir), path, mode="overwrite")
    return libops.fetch_item_fields(load_library(spark, path), ["doi", "title", "year"], library="Shared Group")


def q_paper_xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shredded papers written as <paper> XML (tables with cells, figures) and read back."""
    path = scratch_dir(spark, "papers-xml")
    corpus.write_corpus(corpus.paper_xml_rows(_shredded(spark, sf_dir)), path, mode="overwrite")
    back = corpus.read_paper_xml(spark, path)
    tabs = back.select(F.col("_item_key").alias("item_key"), F.posexplode("tables.table").alias("pos", "t"))
    cells = F.array_join(F.transform(F.coalesce(F.col("t.data.row"), F.array()), lambda r: F.array_join(F.coalesce(r["cell"], F.array().cast("array<string>")), "|")), ";")
    return tabs.select("item_key", F.col("pos").cast("int").alias("pos"), F.col("t._label").alias("label"),
                       F.col("t._caption").alias("caption"), F.col("t._figure_id").alias("figure_id"), cells.alias("cells"))


def q_paper_xml_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their refs through <paper> XML and back."""
    path = scratch_dir(spark, "papers-xml")
    corpus.write_corpus(corpus.paper_xml_rows(_shredded(spark, sf_dir)), path, mode="overwrite")
    back = corpus.papers_from_xml(corpus.read_paper_xml(spark, path))
    s = back.select("item_key", F.explode("sections").alias("s")).select("item_key", "s.*")
    return _refs_joined(s.select("item_key", "pos", "heading", "num", "text", *secops.REF_COLS))


def q_paper_xml_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, formulas and figures of each paper through <paper> XML and back."""
    path = scratch_dir(spark, "papers-xml")
    corpus.write_corpus(corpus.paper_xml_rows(_shredded(spark, sf_dir)), path, mode="overwrite")
    back = corpus.papers_from_xml(corpus.read_paper_xml(spark, path))
    labels = F.array_join(F.transform("figures", lambda f: f["label"]), "|")
    return back.select(
        "item_key", F.array_join("references", "|").alias("references"), F.array_join("formulas", "|").alias("formulas"),
        F.size("figures").alias("n_figures"), labels.alias("figure_labels"),
    )


def q_table_heading_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14 + F16: column and row headings of every table (numeric cells dropped)."""
    t = fx.tables(spark, sf_dir).where(F.size("cells") > 0)
    h = segops.table_heading_lists(F.col("cells"))
    return t.select("item_key", "pos", F.array_join(h["col_headings"], "|").alias("col_headings"),
                    F.array_join(h["row_headings"], "|").alias("row_headings"))


def q_screening_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 (screening): analysed and failed articles of a full screening run."""
    res = scr.analyse_abstracts(_articles(spark, sf_dir), None, fx.rule_model_factory)
    return scr.screening_report(res)


def queries() -> dict[str, QueryFn]:
    return {
        "search_scan": q_search_scan,
        "drop_near_duplicates_whole": q_drop_near_duplicates_whole,
        "export_overwrite": q_export_overwrite,
        "export_failed": q_export_failed,
        "export_resume": q_export_resume,
        "heavy_terms": q_heavy_terms,
        "search_papers_indexed": q_search_papers_indexed,
        "term_frequency_indexed": q_term_frequency_indexed,
        "best_match_doi": q_best_match_doi,
        "export_after_flat": q_export_after_flat,
        "stream_term_frequency": q_stream_term_frequency,
        "exported_sections": q_exported_sections,
        "paper_xml_sections": q_paper_xml_sections,
        "paper_xml_parts": q_paper_xml_parts,
        "build_prompt_300": q_build_prompt_300,
        "few_shot_prompt": q_few_shot_prompt,
        "import_generic_csv": q_import_generic_csv,
        "corrupt_records": q_corrupt_records,
        "screening_report": q_screening_report,
        "library_roundtrip": q_library_roundtrip,
        "paper_xml_roundtrip": q_paper_xml_roundtrip,
        "table_heading_lists": q_table_heading_lists,
        "stream_corpus": q_stream_corpus,
        "stream_append_results": q_stream_append_results,
        "build_prompt": q_build_prompt,
        "answer_prompts": q_answer_prompts,
        "screen_abstracts": q_screen_abstracts,
        "import_csv": q_import_csv,
        "results_csv": q_results_csv,
        "normalize_scopus": q_normalize_scopus,
        "normalize_pubmed": q_normalize_pubmed,
        "publications_by_country": q_publications_by_country,
        "unknown_countries": q_unknown_countries,
        "top_terms": q_top_terms,
        "export_corpus": q_export_corpus,
        "export_report": q_export_report,
        "shred_tei_papers": q_shred_tei_papers,
        "shred_tei_sections": q_shred_tei_sections,
        "shred_tei_tables": q_shred_tei_tables,
        "shred_tei_figures": q_shred_tei_figures,
        "text_segments": q_text_segments,
        "pretty_text": q_pretty_text,
        "flag_duplicates": q_flag_duplicates,
        "drop_near_duplicates": q_drop_near_duplicates,
        "classify_sections": q_classify_sections,
        "merge_sections": q_merge_sections,
        "fetch_item_field": q_fetch_item_field,
        "fetch_item_field_collection": q_fetch_item_field_collection,
        "fetch_item_fields": q_fetch_item_fields,
        "list_local_path": q_list_local_path,
        "list_local_path_strict": q_list_local_path_strict,
        "has_doi": q_has_doi,
        "has_local": q_has_local,
        "missing_dois": q_missing_dois,
        "term_frequency": q_term_frequency,
        "freq_max": q_freq_max,
        "token_frequency": q_token_frequency,
        "merge_duplicates": q_merge_duplicates,
        "union_sources": q_union_sources,
        "append_results": q_append_results,
        "search_papers": q_search_papers,
        "cap_per_year": q_cap_per_year,
        "distinct_titles": q_distinct_titles,
        "exclude_keys": q_exclude_keys,
        "filter_dois": q_filter_dois,
        "year_periods": q_year_periods,
    }
