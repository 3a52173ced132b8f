"""DuckDB SQL twins of the registered queries (the correctness oracle).

Tables ``documents``, ``conversations``, ... are views over the same parquet
files.  Every derivation rule of ``fixtures.py`` is restated here in SQL, so the
oracle checks the Spark operators, not a shared helper.
"""

from __future__ import annotations

from scriptorium.plans import catalog


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words_values() -> str:
    rows = []
    pos = 0
    for w in catalog.TF_WORDS:
        rows.append(f"({pos}, {_q(w)}, {_q(w.replace('_', ' ').strip())})")
        pos += 1
    for label, w in catalog.TF_LABELLED.items():
        rows.append(f"({pos}, {_q(w)}, {_q(label.replace('_', ' ').strip())})")
        pos += 1
    return "(VALUES " + ", ".join(rows) + ") AS w(word_pos, word, label)"


def _tf_cte() -> str:
    return f"""
    d AS (SELECT CAST(2000 + doc_id % 25 AS INTEGER) AS year, lower(text) AS lc FROM documents),
    w AS (SELECT * FROM {_words_values()}),
    tf AS (
      SELECT w.word_pos, w.word, w.label, d.year,
             avg(CAST(regexp_matches(d.lc, w.word) AS DOUBLE)) AS freq
      FROM d CROSS JOIN w
      GROUP BY w.word_pos, w.word, w.label, d.year)"""


TERM_FREQUENCY = f"""
WITH {_tf_cte()},
c1 AS (SELECT *, pow(freq / (max(freq) OVER (PARTITION BY word_pos) + 0.001), 3) AS c FROM tf),
c2 AS (SELECT *, c / (sum(c) OVER (PARTITION BY word_pos) + 0.001) AS p FROM c1),
sc AS (SELECT word_pos, coalesce(sum(p * year), 0.0) AS chrono_score FROM c2 GROUP BY word_pos),
rk AS (SELECT word_pos, chrono_score, CAST(row_number() OVER (ORDER BY chrono_score, word_pos) AS INTEGER) AS chrono_rank FROM sc),
nb AS (
  SELECT tf.*,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY word_pos) AS n,
    lag(freq, 1) OVER w AS m1, lag(freq, 2) OVER w AS m2, lag(freq, 3) OVER w AS m3, lag(freq, 4) OVER w AS m4,
    lead(freq, 1) OVER w AS p1, lead(freq, 2) OVER w AS p2, lead(freq, 3) OVER w AS p3, lead(freq, 4) OVER w AS p4
  FROM tf WINDOW w AS (PARTITION BY word_pos ORDER BY year)),
sm AS (
  SELECT *, CASE
    WHEN n < 5 THEN NULL
    WHEN i = 1 THEN (69 * freq + 4 * p1 - 6 * p2 + 4 * p3 - 1 * p4) / 70.0
    WHEN i = 2 THEN (2 * m1 + 27 * freq + 12 * p1 - 8 * p2 + 2 * p3) / 35.0
    WHEN i = n THEN (69 * freq + 4 * m1 - 6 * m2 + 4 * m3 - 1 * m4) / 70.0
    WHEN i = n - 1 THEN (2 * p1 + 27 * freq + 12 * m1 - 8 * m2 + 2 * m3) / 35.0
    ELSE (-3 * m2 + 12 * m1 + 17 * freq + 12 * p1 - 3 * p2) / 35.0 END AS raw
  FROM nb)
SELECT sm.word, sm.label, sm.year, round(sm.freq, 6) AS freq,
  round(CASE WHEN raw IS NULL THEN NULL WHEN raw < 0 THEN 0.0 WHEN raw > 1 THEN 1.0 ELSE raw END, 6) AS smoothed,
  round(rk.chrono_score, 6) AS chrono_score, rk.chrono_rank
FROM sm JOIN rk USING (word_pos)
"""

FREQ_MAX = f"""
WITH {_tf_cte()}
SELECT round(max(freq), 6) AS freq_max FROM tf
"""


# --- merge and search -------------------------------------------------------

PAPERS_CTE = """
papers AS (
  SELECT
    CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE '10.1/' || md5(d.text) END AS doi,
    CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE split_part(d.text, chr(10), 1) END AS title,
    CASE WHEN d.doc_id % 4 = 1 THEN '' ELSE d.source END AS first_author,
    d.source || '|' || d.lang AS authors,
    CASE WHEN d.doc_id % 6 = 0 THEN '' ELSE d.lang END AS publication,
    CAST(2000 + d.doc_id % 25 AS INTEGER) AS year,
    d.text AS abstract,
    CASE d.doc_id % 3 WHEN 0 THEN 'scopus' WHEN 1 THEN 'crossref' ELSE 'pubmed' END AS source,
    CAST(d.doc_id % 3 AS INTEGER) AS priority,
    d.doc_id AS seq
  FROM documents d)"""


def _first_non_null(cols, ord_expr, text_cols=None):
    out = []
    for c in cols:
        v = f"arg_min({c}, {ord_expr}) FILTER (WHERE {c} IS NOT NULL)"
        if text_cols is None or c in text_cols:
            v = f"coalesce({v}, '')"
        out.append(f"{v} AS {c}")
    return ",\n  ".join(out)


_SOURCE_SET = "coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(source, '|'))))), '|'), '') AS source"
_BLANKED = """SELECT nullif(doi, '') AS doi, nullif(title, '') AS title, nullif(first_author, '') AS first_author,
    nullif(authors, '') AS authors, nullif(publication, '') AS publication, year, nullif(abstract, '') AS abstract,
    nullif(source, '') AS source, priority, seq"""
_STR_COLS = ("title", "first_author", "authors", "publication", "abstract")

MERGE_DUPLICATES = f"""
WITH {PAPERS_CTE},
b AS ({_BLANKED} FROM papers)
SELECT doi,
  {_first_non_null(("title", "first_author", "authors", "publication", "year", "abstract"), "priority * 10000000000 + seq", _STR_COLS)},
  {_SOURCE_SET}
FROM b WHERE doi IS NOT NULL GROUP BY doi
"""

# CrossRef (priority 1) has no abstract column: its abstracts are missing.
UNION_SOURCES = f"""
WITH {PAPERS_CTE},
b AS ({_BLANKED.replace("nullif(abstract, '') AS abstract", "CASE WHEN priority = 1 THEN NULL ELSE nullif(abstract, '') END AS abstract")} FROM papers)
SELECT doi,
  {_first_non_null(("title", "first_author", "authors", "publication", "year", "abstract"), "priority * 10000000000 + seq", _STR_COLS)},
  {_SOURCE_SET}
FROM b WHERE doi IS NOT NULL GROUP BY doi
"""

APPEND_RESULTS = f"""
WITH {PAPERS_CTE},
b AS ({_BLANKED}, seq % 2 AS batch FROM papers)
SELECT doi,
  {_first_non_null(("title", "first_author", "authors", "publication", "year", "abstract"), "batch * 100000000000000 + priority * 10000000000 + seq", _STR_COLS)},
  {_SOURCE_SET}
FROM b WHERE doi IS NOT NULL GROUP BY doi
"""

SEARCH_PAPERS = f"""
WITH {PAPERS_CTE},
hits AS (
  SELECT * FROM papers
  WHERE source IN ('scopus', 'pubmed')
    AND instr(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), 'the') > 0
    AND instr(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), 'of') > 0
    AND year >= 2003 AND year <= 2018
    AND doi IS NOT NULL AND doi <> '' AND title IS NOT NULL AND title <> ''
    AND first_author IS NOT NULL AND first_author <> ''),
capped AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source, CAST(year AS VARCHAR) ORDER BY priority, seq) AS rn FROM hits)
  WHERE rn <= 5),
b AS (SELECT nullif(doi, '') AS doi, nullif(title, '') AS title, nullif(first_author, '') AS first_author, year,
             nullif(source, '') AS source, 'the of' AS query, priority, seq FROM capped)
SELECT doi,
  {_first_non_null(("title", "first_author", "year", "query"), "priority * 10000000000 + seq", ("title", "first_author", "query"))},
  {_SOURCE_SET}
FROM b WHERE doi IS NOT NULL GROUP BY doi
"""

# The records of an earlier scan (every fourth document) come first, then this scan's in engine order.
SEARCH_SCAN = f"""
WITH {PAPERS_CTE},
e AS (
  SELECT doi, {_first_non_null(("title", "first_author", "authors", "publication", "year", "abstract"), "priority * 10000000000 + seq", ())},
         array_to_string(list_sort(list_distinct(list(source))), '|') AS source
  FROM ({_BLANKED} FROM papers) WHERE doi IS NOT NULL AND seq % 4 = 0 GROUP BY doi),
s AS (
  SELECT doi, title, first_author, authors, publication, year, abstract, source, CAST(NULL AS VARCHAR) AS query, -1 AS ord FROM e
  UNION ALL
  SELECT doi, title, first_author, authors, publication, year, abstract, source, 'scan', priority * 10000000000 + seq
  FROM ({_BLANKED} FROM papers)
  WHERE doi IS NOT NULL AND (source <> 'pubmed' OR seq NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)))
SELECT doi,
  {_first_non_null(("title", "first_author", "authors", "publication", "year", "abstract", "query"), "ord", (*_STR_COLS, "query"))},
  {_SOURCE_SET}
FROM s GROUP BY doi
"""

CAP_PER_YEAR = """
SELECT o_orderkey, year, round(o_totalprice, 2) AS o_totalprice FROM (
  SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year,
         row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders) WHERE rn <= 50
"""

DISTINCT_TITLES = f"""
WITH {PAPERS_CTE}
SELECT title, doi, year, source, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY title ORDER BY priority, seq) AS rn FROM papers WHERE title <> '')
WHERE rn = 1
"""

EXCLUDE_KEYS = f"""
WITH {PAPERS_CTE}
SELECT seq, doi, year FROM papers
WHERE seq NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
"""

FILTER_DOIS = f"""
WITH {PAPERS_CTE},
dois AS (SELECT '10.1/' || md5(text) AS doi FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT doi, seq, year, source FROM papers WHERE doi IN (SELECT doi FROM dois)
"""

YEAR_PERIODS = """
WITH d AS (SELECT source, lang, CAST(2000 + doc_id % 25 AS INTEGER) AS year FROM documents),
closed AS (SELECT source AS key, min(year) AS min_year, max(year) AS max_year FROM d GROUP BY source),
opened AS (SELECT lang AS key, min(year) AS min_year FROM d GROUP BY lang)
SELECT key, CAST(y AS INTEGER) AS since, CAST(y AS INTEGER) AS until, CAST(y AS VARCHAR) AS label
FROM closed, (SELECT unnest(range(min_year, max_year + 1)) AS y) AS t
UNION ALL
SELECT key, min_year AS since, CAST(NULL AS INTEGER) AS until, CAST(min_year AS VARCHAR) || '-' AS label FROM opened
"""


# --- reference library ------------------------------------------------------

LIB_CTE = """
parents AS (
  SELECT conv_id + 1 AS itemID, 'P' || lpad(CAST(conv_id AS VARCHAR), 7, '0') AS key,
         CASE WHEN conv_id % 3 = 2 THEN 2 ELSE 1 END AS libraryID, conv_id, text
  FROM conversations WHERE turn = 0),
attach AS (
  SELECT 1000000000 + conv_id * 1000 + turn AS itemID,
         'A' || lpad(CAST(conv_id AS VARCHAR), 7, '0') || '_' || CAST(turn AS VARCHAR) AS key,
         CASE WHEN conv_id % 3 = 2 THEN 2 ELSE 1 END AS libraryID,
         conv_id + 1 AS parentItemID,
         CASE role WHEN 'user' THEN 'application/pdf' WHEN 'assistant' THEN 'text/html' ELSE 'text/plain' END AS contentType,
         CASE WHEN (conv_id + turn) % 6 = 5 THEN NULL
              ELSE 'storage:turn' || CAST(turn AS VARCHAR) ||
                   CASE role WHEN 'user' THEN '.pdf' WHEN 'assistant' THEN '.html' ELSE '.txt' END END AS path
  FROM conversations),
items AS (SELECT itemID, key, libraryID FROM parents UNION ALL SELECT itemID, key, libraryID FROM attach),
vals AS (
  SELECT itemID, 1 AS fieldID, split_part(text, chr(10), 1) AS value FROM parents
  UNION ALL
  SELECT itemID, 8, CASE WHEN conv_id % 11 = 0 THEN 'n.d.'
                         WHEN conv_id % 13 = 0 THEN 'Spring ' || CAST(2000 + conv_id % 25 AS VARCHAR)
                         ELSE CAST(2000 + conv_id % 25 AS VARCHAR) || '-' || lpad(CAST(1 + conv_id % 9 AS VARCHAR), 2, '0') || '-15' END
  FROM parents
  UNION ALL
  SELECT conv_id + 1, 2, string_agg(text, chr(10) ORDER BY turn, text) FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT p.itemID, 59, '10.1/' || md5(d.text) FROM parents p JOIN documents d ON d.doc_id = p.conv_id WHERE p.conv_id % 5 <> 4),
itemData AS (SELECT itemID, fieldID, itemID * 100 + fieldID AS valueID FROM vals),
itemDataValues AS (SELECT itemID * 100 + fieldID AS valueID, value FROM vals),
collectionItems AS (SELECT libraryID * 10 + (conv_id // 3) % 3 AS collectionID, itemID FROM parents)"""


def _field_query(field_id, field_name, library_id, collection_id=None):
    coll = ""
    if collection_id is not None:
        coll = f" AND i.itemID IN (SELECT itemID FROM collectionItems WHERE collectionID = {collection_id})"
    return f"""
WITH {LIB_CTE}
SELECT i.key AS zoteroID, v.value AS {field_name}
FROM items i JOIN itemData d ON i.itemID = d.itemID JOIN itemDataValues v ON d.valueID = v.valueID
WHERE i.libraryID = {library_id} AND d.fieldID = {field_id}{coll}
"""


FETCH_ITEM_FIELD = _field_query(1, "title", 1)
FETCH_ITEM_FIELD_COLLECTION = _field_query(59, "DOI", 2, 21)

FETCH_ITEM_FIELDS = f"""
WITH {LIB_CTE},
f AS (
  SELECT i.key AS zoteroID, d.fieldID, v.value
  FROM items i JOIN itemData d ON i.itemID = d.itemID JOIN itemDataValues v ON d.valueID = v.valueID
  WHERE i.libraryID = 1 AND d.fieldID IN (1, 2, 8, 59))
SELECT zoteroID,
  max(value) FILTER (WHERE fieldID = 59) AS doi,
  max(value) FILTER (WHERE fieldID = 1) AS title,
  max(value) FILTER (WHERE fieldID = 2) AS abstract,
  CAST(nullif(regexp_extract(max(value) FILTER (WHERE fieldID = 8), '([0-9]{{4}})', 1), '') AS INTEGER) AS year
FROM f GROUP BY zoteroID
"""


def _local_path(library_id, prefer_drop_mime, strict):
    keep = (
        f"NOT (n > 1 AND contentType = '{prefer_drop_mime}')"
        if strict
        else f"NOT (has_pdf AND has_html AND contentType = '{prefer_drop_mime}')"
    )
    return f"""
WITH {LIB_CTE},
j AS (
  SELECT i.key AS zoteroID, t.value AS title, dv.value AS doi, a.contentType, a.path, ai.key AS storageID
  FROM items i
  JOIN itemData it ON i.itemID = it.itemID AND it.fieldID = 1 JOIN itemDataValues t ON it.valueID = t.valueID
  JOIN itemData id2 ON i.itemID = id2.itemID AND id2.fieldID = 59 JOIN itemDataValues dv ON id2.valueID = dv.valueID
  JOIN attach a ON i.itemID = a.parentItemID
  JOIN items ai ON a.itemID = ai.itemID
  WHERE i.libraryID = {library_id}),
f AS (
  SELECT *, count(*) OVER (PARTITION BY zoteroID) AS n,
         bool_or(contentType = 'application/pdf') OVER (PARTITION BY zoteroID) AS has_pdf,
         bool_or(contentType = 'text/html') OVER (PARTITION BY zoteroID) AS has_html
  FROM j)
SELECT zoteroID, title, doi,
  CASE contentType WHEN 'application/pdf' THEN 'pdf' WHEN 'text/html' THEN 'html' END AS content_type,
  CASE WHEN path IS NULL THEN NULL ELSE '/data/library/storage/' || storageID || '/' || substr(path, 9) END AS path
FROM f WHERE {keep}
"""


LIST_LOCAL_PATH = _local_path(1, "text/html", False)
LIST_LOCAL_PATH_STRICT = _local_path(2, "application/pdf", True)

PAPER_DOIS = f"""{PAPERS_CTE},
keys AS (SELECT DISTINCT doi FROM papers WHERE doi IS NOT NULL)"""

HAS_DOI = f"""
WITH {LIB_CTE}, {PAPER_DOIS}
SELECT doi, doi IN (SELECT value FROM itemDataValues WHERE value IS NOT NULL) AS in_library FROM keys
"""

HAS_LOCAL = f"""
WITH {LIB_CTE}, {PAPER_DOIS},
local AS (
  SELECT v.value AS doi, min(a.contentType) AS content_type
  FROM itemData d JOIN itemDataValues v ON d.valueID = v.valueID JOIN attach a ON a.parentItemID = d.itemID
  WHERE d.fieldID = 59 GROUP BY v.value)
SELECT keys.doi, local.content_type FROM keys LEFT JOIN local ON keys.doi = local.doi
"""

MISSING_DOIS = f"""
WITH {LIB_CTE}, {PAPER_DOIS}
SELECT doi FROM keys WHERE doi NOT IN (
  SELECT v.value FROM items i JOIN itemData d ON i.itemID = d.itemID JOIN itemDataValues v ON d.valueID = v.valueID
  WHERE d.fieldID = 59 AND i.libraryID IN (1, 2) AND v.value IS NOT NULL)
"""


# --- sections ---------------------------------------------------------------
from scriptorium.plans import fixtures as _fx  # noqa: E402

# white space as Unicode defines it, and the white space at both ends of a text
WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
STRIP = rf"^{WS}+|{WS}+$"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _sql_roman(x: str) -> str:
    def place(d, one, five, ten):
        return (
            f"(CASE WHEN {d} = 9 THEN '{one}{ten}' WHEN {d} >= 5 THEN '{five}' || repeat('{one}', CAST({d} - 5 AS INTEGER)) "
            f"WHEN {d} = 4 THEN '{one}{five}' ELSE repeat('{one}', CAST({d} AS INTEGER)) END)"
        )

    return (
        f"(repeat('M', CAST(({x}) // 1000 AS INTEGER)) || {place(f'(({x}) // 100) % 10', 'C', 'D', 'M')} || "
        f"{place(f'(({x}) // 10) % 10', 'X', 'L', 'C')} || {place(f'({x}) % 10', 'I', 'V', 'X')})"
    )


SECTIONS_CTE = f"""
lines AS (
  SELECT doc_id, unnest(arr) AS text, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents)),
lv AS (
  SELECT doc_id, pos, text, pos // 5 AS m, pos % 5 AS k, doc_id % 4 AS scheme,
         {_list(_fx.SECTION_HEADS)}[pos // 5 % 7 + 1] AS head,
         CASE WHEN pos % 5 > 0 THEN {_list(_fx.SUB_HEADS)}[pos % 5] END AS sub
  FROM lines),
sections AS (
  SELECT doc_id AS item_key, pos,
    CASE scheme
      WHEN 0 THEN CASE WHEN k = 0 THEN head WHEN k = 4 THEN '' ELSE sub END
      WHEN 1 THEN CASE WHEN k = 0 THEN {_sql_roman('m + 1')} || '. ' || head ELSE sub END
      WHEN 2 THEN CASE WHEN k = 0 THEN CASE WHEN m % 2 = 0 THEN upper(head)
                       ELSE upper(split_part(head, ' ', 1)) || substr(head, length(split_part(head, ' ', 1)) + 1) END
                  ELSE sub END
      ELSE CASE WHEN k = 0 THEN head ELSE '' END END AS heading,
    CASE WHEN scheme = 0 THEN
      CASE WHEN k = 0 THEN CAST(m + 1 AS VARCHAR) || CASE WHEN doc_id % 8 = 0 THEN '' ELSE '.' END
           WHEN k = 4 THEN '' ELSE CAST(m + 1 AS VARCHAR) || '.' || CAST(k AS VARCHAR) END
    ELSE '' END AS num,
    text,
    CASE WHEN pos % 3 = 0 THEN ['b' || CAST(pos AS VARCHAR)] ELSE []::VARCHAR[] END AS publication_refs,
    CASE WHEN k = 1 THEN ['fig' || CAST(m AS VARCHAR)] ELSE []::VARCHAR[] END AS figure_refs,
    CASE WHEN k = 2 AND m % 2 = 1 THEN ['tab' || CAST(m AS VARCHAR)] ELSE []::VARCHAR[] END AS table_refs
  FROM lv)"""

_NEAR_DUP = """
d1 AS (
  SELECT *, count(*) OVER g AS n_grp, first_value(pos) OVER gl AS lpos, first_value(wk) OVER gl AS lkey
  FROM (SELECT *, regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g') AS wk FROM sections)
  WINDOW g AS (PARTITION BY item_key, heading, num),
         gl AS (PARTITION BY item_key, heading, num ORDER BY length(text) DESC, pos)),
dedup AS (SELECT * FROM d1 WHERE n_grp = 1 OR pos = lpos OR wk <> lkey)"""

FLAG_DUPLICATES = f"""
WITH {SECTIONS_CTE}
SELECT item_key, pos, count(*) OVER (PARTITION BY item_key, heading, num) > 1 AS is_duplicated FROM sections
"""

DROP_NEAR_DUPLICATES_WHOLE = f"""
WITH {SECTIONS_CTE}, {_NEAR_DUP}
SELECT item_key, pos, heading, num FROM dedup
"""

# the rule on the first 100 word characters
_NEAR_DUP_100 = _NEAR_DUP.replace(" AS wk FROM", "[1:100] AS wk FROM")

DROP_NEAR_DUPLICATES = f"""
WITH {SECTIONS_CTE}, {_NEAR_DUP_100}
SELECT item_key, pos, heading, num FROM dedup
"""

_UPPER_W = "(w = upper(w) AND w <> lower(w))"
_ROMAN_CASE = (
    "CASE lower(split_part(heading, '.', 1)) WHEN '' THEN 0 WHEN 'i' THEN 1 WHEN 'ii' THEN 2 WHEN 'iii' THEN 3 "
    "WHEN 'iv' THEN 4 WHEN 'v' THEN 5 WHEN 'vi' THEN 6 WHEN 'vii' THEN 7 WHEN 'viii' THEN 8 WHEN 'ix' THEN 9 END"
)

CLASSIFY_SECTIONS = f"""
WITH {SECTIONS_CTE}, {_NEAR_DUP},
c AS (
  SELECT item_key, pos, regexp_replace(heading, '{STRIP}', '', 'g') AS heading,
         regexp_replace(num, '{STRIP}', '', 'g') AS num, text, publication_refs, figure_refs, table_refs
  FROM dedup),
st1 AS (
  SELECT *,
    max(CASE WHEN contains(lower(heading), 'introduction') THEN 1 ELSE 0 END) OVER p AS has_intro,
    max(CASE WHEN num IN ('1', '1.') THEN 1 ELSE 0 END) OVER p AS has_n,
    max(CASE WHEN starts_with(lower(heading), 'i. ') THEN 1 ELSE 0 END) OVER p AS has_r,
    max(CASE WHEN heading <> '' AND heading = upper(heading) AND heading <> lower(heading) THEN 1 ELSE 0 END) OVER p AS has_c,
    min(CASE WHEN num IN ('1', '1.') THEN pos END) OVER p AS first_one
  FROM c WINDOW p AS (PARTITION BY item_key)),
st AS (
  SELECT *,
    CASE WHEN has_n = 1 THEN 'N' WHEN has_r = 1 THEN 'R' WHEN has_c = 1 THEN 'C' ELSE 'H' END AS strategy,
    max(CASE WHEN pos = first_one AND num = '1' THEN 1 ELSE 0 END) OVER (PARTITION BY item_key) = 1 AS no_dot,
    string_split_regex(heading, '{WS}+') AS words
  FROM st1),
mk AS (
  SELECT *,
    heading <> '' AND words[1] = upper(words[1]) AND words[1] <> lower(words[1]) AS main_c,
    CAST({_ROMAN_CASE} AS VARCHAR) || '.' AS roman_num,
    substr(heading, instr(heading, '.') + 1) AS after_dot,
    CASE WHEN list_position(list_transform(words, lambda w: {_UPPER_W}), false) IS NULL THEN len(words)
         ELSE list_position(list_transform(words, lambda w: {_UPPER_W}), false) - 1 END AS lead_n
  FROM st),
mk2 AS (
  SELECT *,
    CASE strategy
      WHEN 'N' THEN num <> '' AND CASE WHEN no_dot THEN regexp_matches(num, '^\\p{{Nd}}+$') ELSE regexp_matches(num, '^\\p{{Nd}}+\\.$') END
      WHEN 'R' THEN regexp_matches(lower(heading), '^(?:ix|iv|v?i{{0,3}})\\.')
      WHEN 'C' THEN main_c
      ELSE heading <> '' END AS is_main,
    sum(CASE WHEN main_c THEN 1 ELSE 0 END) OVER (PARTITION BY item_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS cap_idx
  FROM mk),
mk3 AS (
  SELECT *,
    CASE WHEN is_main THEN CASE strategy WHEN 'R' THEN roman_num WHEN 'C' THEN CAST(cap_idx AS VARCHAR) || '.' ELSE num END END AS m_num,
    CASE WHEN is_main THEN CASE strategy WHEN 'R' THEN lower(after_dot)
                                         WHEN 'C' THEN lower(array_to_string(words[1:lead_n], ' '))
                                         ELSE lower(heading) END END AS m_title
  FROM mk2),
ff AS (
  SELECT *, last_value(m_num IGNORE NULLS) OVER w AS c_num, last_value(m_title IGNORE NULLS) OVER w AS c_title
  FROM mk3 WINDOW w AS (PARTITION BY item_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kk AS (
  SELECT *,
    coalesce(c_num, '') AS key_num,
    coalesce(c_title, CASE WHEN has_intro = 1 THEN '' ELSE 'Introduction' END) AS key_title,
    CASE WHEN is_main THEN 'section'
         WHEN strategy = 'N' THEN CASE WHEN num = '' THEN '' WHEN starts_with(num, coalesce(c_num, '')) THEN 'subsection' ELSE '' END
         WHEN strategy IN ('R', 'C') THEN 'subsection' ELSE '' END AS kind,
    CASE WHEN strategy = 'R' AND is_main THEN roman_num ELSE num END AS rnum,
    CASE WHEN strategy = 'R' AND is_main THEN regexp_replace(after_dot, '{STRIP}', '', 'g') ELSE heading END AS rheading
  FROM ff),
rp AS (
  SELECT *, min(pos) OVER g AS first_pos, max(CASE WHEN is_main THEN pos END) OVER g AS last_main
  FROM kk WINDOW g AS (PARTITION BY item_key, key_num, key_title)),
kept AS (SELECT * FROM rp WHERE NOT (strategy IN ('N', 'R') AND last_main IS NOT NULL AND pos < last_main)),
pc AS (
  SELECT *, coalesce(max(CASE WHEN kind <> 'section' OR text <> '' THEN 1 ELSE 0 END)
                     OVER (PARTITION BY item_key, key_num, key_title ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS has_prev
  FROM kept),
pieces AS (
  SELECT *,
    CASE kind
      WHEN 'section' THEN CASE WHEN text <> '' THEN (CASE WHEN has_prev THEN chr(10) ELSE '' END) || text ELSE '' END
      WHEN 'subsection' THEN (CASE WHEN has_prev THEN chr(10) ELSE '' END) || chr(10) || (rnum || ' ' || rheading) || chr(10)
                             || repeat('-', CAST(length(rnum || ' ' || rheading) AS INTEGER))
                             || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END
      ELSE rheading || ' ' || text || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END END AS piece
  FROM pc),
merged AS (
  SELECT item_key, key_num, key_title, first_pos, string_agg(piece, '' ORDER BY pos) AS text,
    flatten(list(publication_refs ORDER BY pos)) AS publication_refs,
    flatten(list(figure_refs ORDER BY pos)) AS figure_refs,
    flatten(list(table_refs ORDER BY pos)) AS table_refs
  FROM pieces GROUP BY item_key, key_num, key_title, first_pos),
idx AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_key ORDER BY first_pos) - 1 AS INTEGER) AS sec_idx FROM merged),
cl0 AS (
  SELECT *, lower(key_title) AS t,
    coalesce(min(CASE WHEN regexp_matches(lower(key_title), 'introduction|background') THEN sec_idx END) OVER (PARTITION BY item_key), 0) AS intro_idx
  FROM idx),
cl1 AS (
  SELECT *, CASE WHEN regexp_matches(t, 'experiments|results|validation|evaluation') THEN 'evaluation'
                 WHEN regexp_matches(t, 'discussion|conclusion|future work') THEN 'conclusion'
                 WHEN regexp_matches(t, 'related work|previous work|literature review') THEN 'related work'
                 WHEN sec_idx = intro_idx THEN 'introduction' ELSE '' END AS c0
  FROM cl0),
cl2 AS (
  SELECT *, contains(t, 'method') AND c0 = '' AS is_m,
         max(CASE WHEN contains(t, 'method') AND c0 = '' THEN 1 ELSE 0 END) OVER (PARTITION BY item_key) = 1 AS any_m
  FROM cl1),
cl3 AS (SELECT *, CASE WHEN any_m AND is_m THEN 'method' WHEN NOT any_m AND sec_idx = intro_idx + 1 THEN 'method' ELSE c0 END AS c1 FROM cl2),
cl4 AS (
  SELECT *, min(CASE WHEN c1 = 'conclusion' THEN sec_idx END) OVER (PARTITION BY item_key) AS first_concl,
    coalesce(last_value(nullif(c1, '') IGNORE NULLS) OVER (PARTITION BY item_key ORDER BY sec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS filled
  FROM cl3)
SELECT item_key, sec_idx, key_title AS heading, key_num AS num, text,
  array_to_string(publication_refs, '|') AS publication_refs,
  array_to_string(figure_refs, '|') AS figure_refs,
  array_to_string(table_refs, '|') AS table_refs,
  CASE WHEN first_concl IS NOT NULL AND sec_idx > first_concl THEN c1 ELSE filled END AS type
FROM cl4
"""

MERGE_SECTIONS = f"""
WITH {SECTIONS_CTE},
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY pos) = 1 AS is_first,
         CASE WHEN num <> '' THEN num || ' ' || heading ELSE heading END AS sub
  FROM sections),
e AS (
  SELECT *, (CASE WHEN NOT is_first AND heading <> '' THEN [sub || chr(10) || repeat('-', CAST(length(sub) AS INTEGER))] ELSE []::VARCHAR[] END)
            || (CASE WHEN text <> '' THEN [text] ELSE []::VARCHAR[] END) AS els
  FROM r)
SELECT item_key, arg_min(heading, pos) AS heading, arg_min(num, pos) AS num,
  array_to_string(flatten(list(els ORDER BY pos)), chr(10)) AS text,
  array_to_string(flatten(list(publication_refs ORDER BY pos)), '|') AS publication_refs,
  array_to_string(flatten(list(figure_refs ORDER BY pos)), '|') AS figure_refs,
  array_to_string(flatten(list(table_refs ORDER BY pos)), '|') AS table_refs
FROM e GROUP BY item_key
"""

_ORACLE_SECTIONS = {
    "flag_duplicates": FLAG_DUPLICATES,
    "drop_near_duplicates": DROP_NEAR_DUPLICATES,
    "drop_near_duplicates_whole": DROP_NEAR_DUPLICATES_WHOLE,
    "classify_sections": CLASSIFY_SECTIONS,
    "merge_sections": MERGE_SECTIONS,
}


def oracle_sql() -> dict[str, str]:
    out = {
        "fetch_item_field": FETCH_ITEM_FIELD,
        "fetch_item_field_collection": FETCH_ITEM_FIELD_COLLECTION,
        "fetch_item_fields": FETCH_ITEM_FIELDS,
        "list_local_path": LIST_LOCAL_PATH,
        "list_local_path_strict": LIST_LOCAL_PATH_STRICT,
        "has_doi": HAS_DOI,
        "has_local": HAS_LOCAL,
        "missing_dois": MISSING_DOIS,
        "term_frequency": TERM_FREQUENCY,
        "freq_max": FREQ_MAX,
        "merge_duplicates": MERGE_DUPLICATES,
        "union_sources": UNION_SOURCES,
        "append_results": APPEND_RESULTS,
        "search_papers": SEARCH_PAPERS,
        "cap_per_year": CAP_PER_YEAR,
        "search_scan": SEARCH_SCAN,
        "distinct_titles": DISTINCT_TITLES,
        "exclude_keys": EXCLUDE_KEYS,
        "filter_dois": FILTER_DOIS,
        "year_periods": YEAR_PERIODS,
    }
    out.update(_ORACLE_SECTIONS)
    return out


# --- segments ---------------------------------------------------------------

TABLES_CTE = """
tabs AS (
  SELECT p_partkey // 2 AS item_key, CAST(p_partkey % 2 AS INTEGER) AS pos,
    'Table ' || CAST(p_partkey % 2 + 1 AS VARCHAR) || ': ' || p_name AS caption,
    CASE WHEN p_partkey % 11 = 0 THEN []::VARCHAR[][]
         ELSE [[CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Method' END, p_brand, 'size'],
               [p_name, CAST(p_retailprice AS VARCHAR), CAST(p_size AS VARCHAR)],
               CASE WHEN p_partkey % 7 = 0 THEN [p_type] ELSE [p_type, '0.5'] END] END AS cells
  FROM part),
figs AS (
  SELECT doc_id AS item_key, pos, text AS caption,
         CASE WHEN pos % 3 = 1 THEN '' ELSE 'Figure ' || CAST(pos + 1 AS VARCHAR) END AS label FROM (
    SELECT doc_id, unnest(arr) AS text, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS pos
    FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents)))"""

_KEEP = "(h IS NOT NULL AND h <> '' AND NOT regexp_matches(replace(h, '.', ''), '^\\p{N}+$'))"

TABLE_HEADINGS_CTE = f"""
th0 AS (
  SELECT item_key, pos,
    list_filter(list_transform(cells, lambda r: r[1]), lambda h: {_KEEP}) AS col,
    list_filter(coalesce(cells[1], []::VARCHAR[]), lambda h: {_KEEP}) AS rw
  FROM tabs),
th AS (
  SELECT item_key, pos,
    CASE WHEN len(col) > 0 THEN CASE WHEN len(rw) > 0 THEN array_to_string(col, ' ; ') || ' | ' || array_to_string(rw[2:], ' ; ')
                                     ELSE array_to_string(col, ' ; ') END
         ELSE array_to_string(rw, ' ; ') END AS headings
  FROM th0)"""


def _seg(kind: str) -> str:
    return f"regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY sec_idx) FILTER (WHERE type = '{kind}'), ''), '{STRIP}', '', 'g') AS {kind.replace(' ', '_')}"


TEXT_SEGMENTS = f"""
WITH cls AS ({CLASSIFY_SECTIONS}),
{TABLES_CTE}, {TABLE_HEADINGS_CTE},
sec AS (SELECT item_key, {", ".join(_seg(k) for k in ("introduction", "related work", "method", "evaluation", "conclusion"))} FROM cls GROUP BY item_key),
tc AS (SELECT item_key, string_agg(caption, chr(10) ORDER BY pos) AS table_captions FROM tabs GROUP BY item_key),
thh AS (SELECT item_key, string_agg(headings, chr(10) ORDER BY pos) AS table_headings FROM th WHERE headings <> '' GROUP BY item_key),
fc AS (SELECT item_key, string_agg(caption, chr(10) ORDER BY pos) AS figure_captions FROM figs GROUP BY item_key)
SELECT d.doc_id AS item_key,
  coalesce(sec.introduction, '') AS introduction, coalesce(sec.related_work, '') AS related_work,
  coalesce(sec.method, '') AS method, coalesce(sec.evaluation, '') AS evaluation, coalesce(sec.conclusion, '') AS conclusion,
  coalesce(tc.table_captions, '') AS table_captions, coalesce(thh.table_headings, '') AS table_headings,
  coalesce(fc.figure_captions, '') AS figure_captions
FROM documents d LEFT JOIN sec ON sec.item_key = d.doc_id LEFT JOIN tc ON tc.item_key = d.doc_id
  LEFT JOIN thh ON thh.item_key = d.doc_id LEFT JOIN fc ON fc.item_key = d.doc_id
"""

PRETTY_TEXT = f"""
WITH cls AS ({CLASSIFY_SECTIONS})
SELECT item_key, string_agg(num || ' | ' || upper(heading) || CASE WHEN type <> '' THEN ' [' || type || ']' ELSE '' END
                            || chr(10) || text, chr(10) || chr(10) || '==============================' || chr(10) || chr(10) ORDER BY sec_idx) AS pretty_text
FROM cls GROUP BY item_key
"""

_ORACLE_SECTIONS.update({"text_segments": TEXT_SEGMENTS, "pretty_text": PRETTY_TEXT})


# --- TEI round trip ------------------------------------------------------------

def _py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{STRIP}', '', 'g')"

SHRED_TEI_PAPERS = f"""
WITH {SECTIONS_CTE}, {TABLES_CTE},
ns AS (SELECT item_key, count(*) AS n FROM sections
       WHERE NOT (heading = '' AND {_py_strip('text')} = '') GROUP BY item_key),
nt AS (SELECT item_key, count(*) AS n FROM tabs GROUP BY item_key),
nf AS (SELECT item_key, count(*) AS n FROM figs GROUP BY item_key)
SELECT d.doc_id AS item_key, {_py_strip("split_part(d.text, chr(10), 1)")} AS title,
  {_py_strip("split_part(d.text, chr(10), 2)")} AS abstract,
  CAST(coalesce(ns.n, 0) AS INTEGER) AS n_sections, CAST(coalesce(nt.n, 0) AS INTEGER) AS n_tables,
  CAST(coalesce(nf.n, 0) AS INTEGER) AS n_figures, '' AS error
FROM documents d LEFT JOIN ns ON ns.item_key = d.doc_id LEFT JOIN nt ON nt.item_key = d.doc_id LEFT JOIN nf ON nf.item_key = d.doc_id
"""

SHRED_TEI_SECTIONS = f"""
WITH {SECTIONS_CTE},
kept AS (SELECT *, {_py_strip('text')} AS stext FROM sections WHERE NOT (heading = '' AND {_py_strip('text')} = ''))
SELECT item_key, CAST(row_number() OVER (PARTITION BY item_key ORDER BY pos) - 1 AS INTEGER) AS pos, heading, num, stext AS text,
  array_to_string(publication_refs, '|') AS publication_refs, array_to_string(figure_refs, '|') AS figure_refs,
  array_to_string(table_refs, '|') AS table_refs
FROM kept
"""

SHRED_TEI_TABLES = f"""
WITH {TABLES_CTE}
SELECT t.item_key, CAST(row_number() OVER (PARTITION BY t.item_key ORDER BY t.pos) - 1 AS INTEGER) AS pos,
  'Table ' || CAST(t.pos + 1 AS VARCHAR) AS label, t.caption, 'tab' || CAST(t.item_key * 2 + t.pos AS VARCHAR) AS figure_id,
  array_to_string(list_transform(t.cells, lambda r: array_to_string(r, '|')), ';') AS cells
FROM tabs t
"""

SHRED_TEI_FIGURES = f"""
WITH {TABLES_CTE}
SELECT item_key, CAST(row_number() OVER (PARTITION BY item_key ORDER BY pos) - 1 AS INTEGER) AS pos,
  label, label || caption AS caption, 'figure' AS type, 'fig' || CAST(pos AS VARCHAR) AS figure_id
FROM figs
"""

_ORACLE_SECTIONS.update({
    "shred_tei_papers": SHRED_TEI_PAPERS,
    "shred_tei_sections": SHRED_TEI_SECTIONS,
    "shred_tei_tables": SHRED_TEI_TABLES,
    "shred_tei_figures": SHRED_TEI_FIGURES,
})


# --- corpus export ----------------------------------------------------------------

SHREDDED_SECTIONS_CTE = SECTIONS_CTE.replace("\nsections AS (", "\nraw_sections AS (") + f""",
sections AS (
  SELECT item_key, pos, heading, num, {_py_strip('text')} AS text, publication_refs, figure_refs, table_refs
  FROM raw_sections WHERE NOT (heading = '' AND {_py_strip('text')} = ''))"""

_EXPORT_CANDIDATES = f"""
{LIB_CTE},
j AS (
  SELECT i.key AS zoteroID, p.conv_id, t.value AS title, dv.value AS doi, a.contentType,
         CASE WHEN a.path IS NULL THEN NULL ELSE '/data/library/storage/' || ai.key || '/' || substr(a.path, 9) END AS path
  FROM items i JOIN parents p ON p.itemID = i.itemID
  JOIN itemData it ON i.itemID = it.itemID AND it.fieldID = 1 JOIN itemDataValues t ON it.valueID = t.valueID
  JOIN itemData id2 ON i.itemID = id2.itemID AND id2.fieldID = 59 JOIN itemDataValues dv ON id2.valueID = dv.valueID
  JOIN attach a ON i.itemID = a.parentItemID
  JOIN items ai ON a.itemID = ai.itemID
  WHERE i.libraryID = 1),
listing AS (
  SELECT '/data/library/storage/A' || lpad(CAST(conv_id AS VARCHAR), 7, '0') || '_' || CAST(turn AS VARCHAR) || '/turn' || CAST(turn AS VARCHAR)
         || CASE role WHEN 'user' THEN '.pdf' WHEN 'assistant' THEN '.html' ELSE '.txt' END AS path
  FROM conversations WHERE (conv_id + turn) % 6 <> 5 AND (conv_id + turn) % 4 <> 1),
ex AS (SELECT * FROM j WHERE path IS NOT NULL AND path IN (SELECT path FROM listing)),
pf AS (
  SELECT *, bool_or(contentType = 'application/pdf') OVER (PARTITION BY zoteroID) AS has_pdf,
            bool_or(contentType = 'text/html') OVER (PARTITION BY zoteroID) AS has_html
  FROM ex),
cand AS (SELECT * FROM pf WHERE NOT (has_pdf AND has_html AND contentType = 'text/html') AND contentType = 'application/pdf'),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zoteroID ORDER BY path) AS rk FROM cand) WHERE rk = 1)"""

EXPORT_REPORT = f"""
WITH {_EXPORT_CANDIDATES}
SELECT 'exported' AS status, CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'failed', CAST(0 AS BIGINT)
UNION ALL SELECT 'skipped', count(*) FROM firsts
UNION ALL SELECT 'other_file', (SELECT count(*) FROM cand) - (SELECT count(*) FROM firsts)
"""

EXPORT_FAILED = f"""
WITH {_EXPORT_CANDIDATES}
SELECT 'exported' AS status, count(*) FILTER (WHERE conv_id % 4 NOT IN (1, 2)) AS n FROM firsts
UNION ALL SELECT 'failed', count(*) FILTER (WHERE conv_id % 4 IN (1, 2)) FROM firsts
UNION ALL SELECT 'skipped', CAST(0 AS BIGINT)
UNION ALL SELECT 'other_file', (SELECT count(*) FROM cand) - (SELECT count(*) FROM firsts)
"""

_SHREDDED_CLASSIFY = CLASSIFY_SECTIONS.replace(SECTIONS_CTE, SHREDDED_SECTIONS_CTE)


EXPORT_CORPUS = f"""
WITH {_EXPORT_CANDIDATES},
cls AS ({_SHREDDED_CLASSIFY}),
{TABLES_CTE}, {TABLE_HEADINGS_CTE},
sec AS (SELECT item_key, {", ".join(_seg(k) for k in ("introduction", "related work", "method", "evaluation", "conclusion"))} FROM cls GROUP BY item_key),
tc AS (SELECT item_key, string_agg(caption, chr(10) ORDER BY pos) AS v FROM tabs GROUP BY item_key),
thh AS (SELECT item_key, string_agg(headings, chr(10) ORDER BY pos) AS v FROM th WHERE headings <> '' GROUP BY item_key),
fc AS (SELECT item_key, string_agg(label || caption, chr(10) ORDER BY pos) AS v FROM figs GROUP BY item_key),
yr AS (
  SELECT i.key AS zoteroID, CAST(nullif(regexp_extract(v.value, '([0-9]{{4}})', 1), '') AS INTEGER) AS year
  FROM items i JOIN itemData d ON i.itemID = d.itemID JOIN itemDataValues v ON d.valueID = v.valueID
  WHERE i.libraryID = 1 AND d.fieldID = 8)
SELECT f.zoteroID AS item_key, f.doi, f.title, f.path,
  {_py_strip("coalesce(split_part(doc.text, chr(10), 2), '')")} AS abstract,
  {_py_strip("coalesce(sec.introduction, '')")} AS introduction,
  {_py_strip("coalesce(sec.related_work, '')")} AS related_work,
  {_py_strip("coalesce(sec.method, '')")} AS method,
  {_py_strip("coalesce(sec.evaluation, '')")} AS evaluation,
  {_py_strip("coalesce(sec.conclusion, '')")} AS conclusion,
  {_py_strip("coalesce(tc.v, '')")} AS table_captions,
  {_py_strip("coalesce(thh.v, '')")} AS table_headings,
  {_py_strip("coalesce(fc.v, '')")} AS figure_captions,
  yr.year
FROM firsts f JOIN documents doc ON doc.doc_id = f.conv_id
  JOIN yr ON yr.zoteroID = f.zoteroID
  LEFT JOIN sec ON sec.item_key = f.conv_id LEFT JOIN tc ON tc.item_key = f.conv_id
  LEFT JOIN thh ON thh.item_key = f.conv_id LEFT JOIN fc ON fc.item_key = f.conv_id
"""

EXPORTED_SECTIONS = f"""
WITH {_EXPORT_CANDIDATES}, cls AS ({_SHREDDED_CLASSIFY})
SELECT f.zoteroID AS item_key, c.sec_idx AS pos, {_py_strip("c.heading")} AS heading, c.num, c.type,
  c.publication_refs, c.figure_refs, c.table_refs
FROM firsts f JOIN cls c ON c.item_key = f.conv_id
"""

_ORACLE_SECTIONS.update({
    "export_corpus": EXPORT_CORPUS, "export_overwrite": EXPORT_CORPUS, "export_resume": EXPORT_CORPUS,
    "export_report": EXPORT_REPORT, "export_failed": EXPORT_FAILED, "exported_sections": EXPORTED_SECTIONS,
})


# --- countries and terms ------------------------------------------------------------

# The ISO code expected for each affiliation text of the fixtures.
EXPECTED_COUNTRIES = (
    ("Hong Kong", "CHN"), ("South Korea", "KOR"), ("Ciudad de México, DF", "MEX"), ("Atlantis", ""), ("Boston, USA", "USA"),
    ("Paris, France", "FRA"), ("Montréal, Canada", "CAN"), ("Berlin, Germany", "DEU"), ("London", "GBR"), ("Tokyo, Japan", "JPN"),
    ("Isfahan Iran", "IRN"), ("Durban South Africa", "ZAF"), ("Kolkata, West Bengal", "IND"), ("Saudia Arabia", "SAU"),
    ("Zürich, Switzerland", "CHE"), ("Algérie", "DZA"), ("Lima, Peru", "PER"), ("china", ""), ("Brno, Czechia", "CZE"),
    ("Cardiff, Wales", "GBR"), ("P. O. Box Saudi Arabia", "SAU"), ("Sydney, Australia", "AUS"), ("Seoul", "KOR"), ("Narnia", ""),
    ("U.S.A", "USA"),
)


def _country_case(x: str) -> str:
    whens = " ".join(f"WHEN {_q(name)} THEN {_q(iso)}" for name, iso in EXPECTED_COUNTRIES)
    return f"CASE {x} {whens} END"


ORDER_RECORDS_CTE = f"""
rec AS (
  SELECT '10.2/' || CAST(o.o_orderkey AS VARCHAR) AS doi, strftime(o.o_orderdate, '%Y-%m-%d') AS date,
    CASE WHEN o.o_orderkey % 3 = 0 THEN [{_list(_fx.NATION_COUNTRIES)}[c.c_nationkey + 1], {_list(_fx.NATION_COUNTRIES)}[(c.c_nationkey + o.o_orderkey) % 25 + 1]]
         ELSE [{_list(_fx.NATION_COUNTRIES)}[c.c_nationkey + 1]] END AS affiliation_country
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
ex AS (SELECT doi, date, unnest(affiliation_country) AS country FROM rec)"""

PUBLICATIONS_BY_COUNTRY = f"""
WITH {ORDER_RECORDS_CTE}
SELECT {_country_case('country')} AS iso, CAST(nullif(regexp_extract(date, '^([0-9]{{4}})', 1), '') AS INTEGER) AS year,
  count(DISTINCT doi) AS n_papers
FROM ex GROUP BY ALL
"""

UNKNOWN_COUNTRIES = f"""
WITH {ORDER_RECORDS_CTE}
SELECT country, count(*) AS n FROM ex WHERE {_country_case('country')} = '' GROUP BY country
"""

TOP_TERMS = """
WITH t AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS term FROM documents),
c AS (SELECT lang, term, count(*) AS n FROM t WHERE term <> '' GROUP BY lang, term)
SELECT lang, term, n, CAST(rn AS INTEGER) AS term_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rn FROM c) WHERE rn <= 20
"""

_ORACLE_SECTIONS.update({
    "publications_by_country": PUBLICATIONS_BY_COUNTRY,
    "unknown_countries": UNKNOWN_COUNTRIES,
    "top_terms": TOP_TERMS, "heavy_terms": TOP_TERMS,
})


# --- landed search results ------------------------------------------------------------

IMPORT_CSV = """
WITH rec AS (
  SELECT nullif(split_part(text, chr(10), 1), '') AS title, source || ', ' || lang AS authors,
    nullif(split_part(source || ', ' || lang, ',', 1), '') AS first_author, nullif(lang, '') AS publication,
    CASE WHEN doc_id % 2 = 0 THEN 'Journal' ELSE 'Book' END AS publication_type,
    CAST(2000 + doc_id % 25 AS INTEGER) AS year, n_chars % 97 AS citations_count,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '10.1/' || md5(text) END AS doi, nullif(text, '') AS abstract,
    lpad(CAST(doc_id AS VARCHAR), 8, '0') AS issn
  FROM documents),
works AS (
  SELECT lower(trim(split_part(text, chr(10), 1))) AS t, lower(trim(source)) AS a, CAST(2000 + doc_id % 25 AS INTEGER) AS y,
         min('10.1/' || md5(text)) AS w
  FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT coalesce(rec.doi, works.w) AS doi, title, first_author, authors, publication, publication_type, year, citations_count,
  abstract, issn, 'pop' AS source, 'imported' AS query
FROM rec LEFT JOIN works ON rec.doi IS NULL AND works.t = lower(trim(rec.title)) AND works.a = lower(trim(rec.first_author)) AND works.y = rec.year
"""

def _words(c: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]+')))"


def _variants(c: str) -> str:
    return f"list_distinct(list_filter([{_words(c)}, {_words(f"regexp_replace({c}, '[:\u2013\u2014].*$', '', 's')")}], lambda s: len(s) > 0))"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE 1000 * {both} // (len({a}) + len({b}) - {both}) END)"


# all pairs of records and works
BEST_MATCH_DOI = f"""
WITH r AS (
  SELECT doc_id AS seq, CASE doc_id % 4 WHEN 1 THEN t || ': a view from ' || source || ' and beyond' WHEN 2 THEN 'q' || t WHEN 3 THEN regexp_replace(t, '[^ ]+$', '') ELSE t END AS title,
    source || ' Smith' AS author, CASE WHEN doc_id % 5 <> 0 THEN lang END AS publication,
    2000 + doc_id % 25 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS year
  FROM (SELECT *, split_part(text, chr(10), 1) AS t FROM documents)
), w AS (
  SELECT split_part(text, chr(10), 1) AS title, source AS author, lang AS publication, 2000 + doc_id % 25 AS year, '10.1/' || md5(text) AS doi
  FROM documents WHERE doc_id % 2 = 0
), rs AS (
  SELECT seq, year, {_words("author")} AS a, {_words("publication")} AS p, unnest({_variants("title")}) AS s FROM r
), ws AS (
  SELECT DISTINCT doi, year, {_words("author")} AS a, {_words("publication")} AS p, unnest({_variants("title")}) AS s FROM w
), sets AS (
  SELECT x.s AS xs, y.s AS ys, {_jaccard("x.s", "y.s")} AS sim FROM (SELECT DISTINCT s FROM rs) x, (SELECT DISTINCT s FROM ws) y
), scored AS (
  SELECT rs.seq, ws.doi, 6 * sim + 2 * {_jaccard("rs.a", "ws.a")} + {_jaccard("rs.p", "ws.p")}
    + CASE abs(rs.year - ws.year) WHEN 0 THEN 1000 WHEN 1 THEN 500 ELSE 0 END AS score
  FROM sets JOIN rs ON rs.s = xs JOIN ws ON ws.s = ys WHERE sim >= 600
), best AS (
  SELECT seq, doi, score FROM scored QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, doi) = 1
)
SELECT r.seq, r.title, best.doi, CAST(best.score AS INTEGER) AS match_score FROM r LEFT JOIN best USING (seq)
"""

RESULTS_CSV = f"""
WITH {PAPERS_CTE},
b AS ({_BLANKED} FROM papers),
m AS (
  SELECT doi,
    {_first_non_null(("title", "first_author", "authors", "publication", "year", "abstract"), "priority * 10000000000 + seq", ())},
    {_SOURCE_SET}
  FROM b WHERE doi IS NOT NULL GROUP BY doi)
SELECT doi, title, first_author, authors, publication, CAST(year AS VARCHAR) AS year, abstract, source, 'doi' AS first_column FROM m
"""

_DOCS_CUST = """
j AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, split_part(d.text, chr(10), 1) AS line,
         c.c_custkey, c.c_name, c.c_nationkey, c.c_mktsegment
  FROM documents d LEFT JOIN customer c ON d.doc_id = c.c_custkey)"""

NORMALIZE_SCOPUS = f"""
WITH {_DOCS_CUST}
SELECT '10.1/' || md5(text) AS doi, line AS title, source AS first_author, source || '|' || lang AS authors, lang AS publication,
  CASE WHEN doc_id % 2 = 0 THEN 'Journal' ELSE '' END AS publication_type,
  CASE WHEN doc_id % 9 <> 0 THEN CAST(2000 + doc_id % 25 AS INTEGER) END AS year,
  CASE WHEN doc_id % 9 <> 0 THEN CAST(2000 + doc_id % 25 AS VARCHAR) || '-0' || CAST(1 + doc_id % 9 AS VARCHAR) || '-01' ELSE '' END AS date,
  'SCOPUS_ID:' || CAST(doc_id AS VARCHAR) AS scopus_id,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS pmid,
  text AS abstract,
  array_to_string(string_split(lower(line), ' '), '|') AS keywords,
  n_chars % 50 AS citations_count,
  CASE WHEN c_custkey IS NULL THEN '' ELSE array_to_string(list_sort(list_distinct([c_name, c_mktsegment])), '|') END AS affiliation,
  CASE WHEN c_custkey IS NULL THEN ''
       ELSE array_to_string(list_sort(list_distinct([{_list(_fx.NATION_COUNTRIES)}[c_nationkey + 1], ''])), '|') END AS affiliation_country
FROM j WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0
"""

NORMALIZE_PUBMED = f"""
WITH {_DOCS_CUST}
SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '10.1/' || md5(text) END AS doi, line AS title, source AS first_author,
  source || '|' || lang AS authors, lang AS publication,
  CASE WHEN doc_id % 10 = 5 THEN 'book' WHEN doc_id % 4 <> 3 THEN 'Journal Article' ELSE 'other' END AS publication_type,
  CAST(2000 + doc_id % 25 AS INTEGER) AS year,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(2000 + doc_id % 25 AS VARCHAR) || '-0' || CAST(1 + doc_id % 9 AS VARCHAR) || '-15' END AS date,
  CAST(doc_id AS VARCHAR) AS pmid, text AS abstract,
  array_to_string(string_split(lower(line), ' '), '|') AS keywords,
  CASE WHEN c_custkey IS NULL THEN '' ELSE array_to_string(list_sort(list_distinct([c_name, 'Dept ' || c_mktsegment])), '|') END AS affiliation
FROM j
"""

IMPORT_GENERIC_CSV = f"""
WITH {PAPERS_CTE}
SELECT doi, nullif(title, '') AS title, nullif(first_author, '') AS first_author, nullif(publication, '') AS publication, authors,
  CASE WHEN seq % 10 = 3 THEN NULL ELSE year END AS year, seq % 31 AS citations_count, 'generic' AS source
FROM papers
"""

CORRUPT_RECORDS = """
SELECT f.format, CASE WHEN doc_id % 5 = 0 THEN 'corrupt' ELSE 'read' END AS status, count(*) AS n
FROM documents CROSS JOIN (VALUES ('json'), ('csv'), ('xml')) AS f(format) GROUP BY ALL
"""

_ORACLE_SECTIONS.update({
    "import_generic_csv": IMPORT_GENERIC_CSV,
    "corrupt_records": CORRUPT_RECORDS,
    "import_csv": IMPORT_CSV,
    "best_match_doi": BEST_MATCH_DOI,
    "results_csv": RESULTS_CSV,
    "normalize_scopus": NORMALIZE_SCOPUS,
    "normalize_pubmed": NORMALIZE_PUBMED,
})


# --- screening ----------------------------------------------------------------------

_ARTICLES = f"""
{LIB_CTE},
f AS (
  SELECT i.key AS zoteroID,
    max(v.value) FILTER (WHERE d.fieldID = 59) AS doi, max(v.value) FILTER (WHERE d.fieldID = 1) AS title,
    max(v.value) FILTER (WHERE d.fieldID = 2) AS abstract
  FROM items i JOIN itemData d ON i.itemID = d.itemID JOIN itemDataValues v ON d.valueID = v.valueID
  WHERE i.libraryID = 1 AND d.fieldID IN (1, 2, 59) GROUP BY i.key),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY zoteroID) AS rn FROM f
                     WHERE doi IS NOT NULL AND title IS NOT NULL AND abstract IS NOT NULL) WHERE rn = 1),
w AS (SELECT *, list_filter(string_split(replace(abstract, chr(9), ''), ' '), lambda x: x <> '') AS words FROM a),
x AS (SELECT *, array_to_string(words, ' ') AS abs_all, len(words) AS n,
             array_to_string(CASE WHEN len(words) <= 300 THEN words ELSE list_slice(words, len(words) - 299, len(words)) END, ' ') AS abs300
      FROM w)"""

BUILD_PROMPT = f"""
WITH {_ARTICLES}
SELECT doi, 'USER PAPER:' || title || '.' || chr(10) || abs_all AS user_paper FROM x
"""

BUILD_PROMPT_300 = BUILD_PROMPT.replace("abs_all AS user_paper", "abs300 AS user_paper")

_FEW_SHOT_TEXT = """system: You are an accurate AI assistant answering Multiple-Choices questions on research papers. Your answers are always one of the provided choices.
system: Here are some examples of conversations.
user: EXAMPLE PAPER 1: A first paper
About roads.
user: Which language is mostly used in the paper?
English
Chinese
German
other
agent: English
user: Which type of images is mostly used in EXAMPLE PAPER 1?
color fundus
OCT or OCTA
angiography or angiograms
slit lamp
ultrasound
3D images
MR
CT
other
agent: other
user: EXAMPLE PAPER 2: Vessels
Eyes.
user: Which type of images is mostly used in EXAMPLE PAPER 2?
color fundus
OCT or OCTA
angiography or angiograms
slit lamp
ultrasound
3D images
MR
CT
other
agent: color fundus
user: Which structure is segmented by the method proposed in EXAMPLE PAPER 2?
optic disc
macula or fovea
retinal vessels
arteries and veins
lesions
microaneurysms or hemorrhages
other
agent: retinal vessels
system: ---
system: You are now ready to answer questions about the abstracts of research papers.
user: USER PAPER:"""
_CONTRIBUTION_TEXT = """
user: Which sentence best describes the contribution of USER PAPER?
review other research papers
novel segmentation method
novel artery and vein classification method
novel diagnosis method
other"""

FEW_SHOT_PROMPT = f"""
WITH {_ARTICLES}
SELECT doi, 16 AS n_messages, {_q(_FEW_SHOT_TEXT)} || title || '.' || chr(10) || abs_all || {_q(_CONTRIBUTION_TEXT)} AS prompt FROM x
"""

SCREEN_ABSTRACTS = f"""
WITH {_ARTICLES},
r AS (
  SELECT *, ' ' || abs_all || ' ' AS pad,
    CASE WHEN contains(' ' || abs_all || ' ', ' the ') THEN 'English'
         WHEN contains(' ' || abs_all || ' ', ' und ') OR contains(' ' || abs_all || ' ', ' der ') THEN 'German'
         ELSE 'spanish or french' END AS m_lang,
    CASE n % 3 WHEN 0 THEN 'color fundus' WHEN 1 THEN 'OCT or OCTA' ELSE 'other' END AS m_img,
    CASE n % 4 WHEN 0 THEN 'novel segmentation method' WHEN 1 THEN 'novel artery and vein classification method'
               WHEN 2 THEN 'review other research papers' ELSE 'hmm' END AS m_con,
    CASE WHEN n % 2 = 0 THEN 'retinal vessels' ELSE 'optic disc' END AS m_str
  FROM x),
c AS (
  SELECT *,
    CASE WHEN n >= 5 THEN m_lang END AS language,
    CASE WHEN n >= 5 AND contains(m_lang, 'English') THEN m_img END AS image
  FROM r),
c2 AS (SELECT *, CASE WHEN image IS NOT NULL AND contains(image, 'color fundus') THEN m_con END AS contribution FROM c),
c3 AS (
  SELECT *, CASE WHEN contribution IS NOT NULL AND NOT contains(contribution, 'artery and vein') AND contains(contribution, 'segmentation')
                 THEN m_str END AS structure
  FROM c2)
SELECT doi, title, language, image, contribution, structure,
  CASE WHEN n < 5 THEN NULL ELSE coalesce(contains(structure, 'vessels'), false) END AS fundus_vessel_segmentation,
  CASE WHEN n < 5 THEN NULL ELSE coalesce(contains(contribution, 'artery and vein'), false) END AS fundus_vessel_classification,
  CASE WHEN n < 5 THEN 'ValueError: abstract too short' END AS error
FROM c3
"""

_ORACLE_SECTIONS.update({
    "build_prompt": BUILD_PROMPT, "build_prompt_300": BUILD_PROMPT_300, "few_shot_prompt": FEW_SHOT_PROMPT,
    "screen_abstracts": SCREEN_ABSTRACTS,
})


# --- streaming ----------------------------------------------------------------------

STREAM_CORPUS = f"""
WITH segs AS ({TEXT_SEGMENTS})
SELECT CAST(d.doc_id AS VARCHAR) AS item_key, '10.1/' || md5(d.text) AS doi, split_part(d.text, chr(10), 1) AS title,
  '/corpus/' || CAST(d.doc_id AS VARCHAR) || '.pdf' AS path,
  {_py_strip("split_part(d.text, chr(10), 2)")} AS abstract,
  {", ".join(_py_strip(f"segs.{c}") + f" AS {c}" for c in ("introduction", "related_work", "method", "evaluation", "conclusion", "table_captions", "table_headings", "figure_captions"))}
FROM documents d JOIN segs ON segs.item_key = d.doc_id
"""

EXPORT_AFTER_FLAT = f"""
SELECT * FROM ({STREAM_CORPUS}) UNION ALL BY NAME SELECT * EXCLUDE (year) FROM ({EXPORT_CORPUS})
"""

_ORACLE_SECTIONS.update({
    "stream_corpus": STREAM_CORPUS, "stream_append_results": MERGE_DUPLICATES, "stream_term_frequency": TERM_FREQUENCY, "term_frequency_indexed": TERM_FREQUENCY, "search_papers_indexed": SEARCH_PAPERS,
    "export_after_flat": EXPORT_AFTER_FLAT,
})


# --- storage round trips -------------------------------------------------------------

LIBRARY_ROUNDTRIP = f"""
WITH {LIB_CTE},
f AS (
  SELECT i.key AS zoteroID, d.fieldID, v.value
  FROM items i JOIN itemData d ON i.itemID = d.itemID JOIN itemDataValues v ON d.valueID = v.valueID
  WHERE i.libraryID = 2 AND d.fieldID IN (1, 8, 59))
SELECT zoteroID,
  max(value) FILTER (WHERE fieldID = 59) AS doi,
  max(value) FILTER (WHERE fieldID = 1) AS title,
  CAST(nullif(regexp_extract(max(value) FILTER (WHERE fieldID = 8), '([0-9]{{4}})', 1), '') AS INTEGER) AS year
FROM f GROUP BY zoteroID
"""

PAPER_XML_ROUNDTRIP = f"""
WITH {TABLES_CTE}
SELECT CAST(t.item_key AS VARCHAR) AS item_key, CAST(row_number() OVER (PARTITION BY t.item_key ORDER BY t.pos) - 1 AS INTEGER) AS pos,
  'Table ' || CAST(t.pos + 1 AS VARCHAR) AS label, t.caption, 'tab' || CAST(t.item_key * 2 + t.pos AS VARCHAR) AS figure_id,
  array_to_string(list_transform(t.cells, lambda r: array_to_string(r, '|')), ';') AS cells
FROM tabs t
"""

PAPER_XML_SECTIONS = SHRED_TEI_SECTIONS.replace("SELECT item_key,", "SELECT CAST(item_key AS VARCHAR) AS item_key,")

PAPER_XML_PARTS = f"""
WITH {TABLES_CTE},
f AS (SELECT item_key, count(*) AS n, string_agg(label, '|' ORDER BY pos) AS labels FROM figs GROUP BY item_key)
SELECT CAST(d.doc_id AS VARCHAR) AS item_key, d.source || '|' || d.lang AS references, 'n = ' || CAST(d.n_chars AS VARCHAR) AS formulas,
  CAST(coalesce(f.n, 0) AS INTEGER) AS n_figures, coalesce(f.labels, '') AS figure_labels
FROM documents d LEFT JOIN f ON f.item_key = d.doc_id
"""

TABLE_HEADING_LISTS = f"""
WITH {TABLES_CTE},
k AS (
  SELECT item_key, pos,
    list_filter(list_transform(cells, lambda r: r[1]), lambda h: h IS NOT NULL AND NOT regexp_matches(replace(h, '.', ''), '^\\p{{N}}+$')) AS col,
    list_filter(cells[1], lambda h: h IS NOT NULL AND NOT regexp_matches(replace(h, '.', ''), '^\\p{{N}}+$')) AS rw
  FROM tabs WHERE len(cells) > 0)
SELECT item_key, pos, array_to_string(col, '|') AS col_headings, array_to_string(rw, '|') AS row_headings FROM k
"""

_ORACLE_SECTIONS.update({
    "library_roundtrip": LIBRARY_ROUNDTRIP,
    "paper_xml_roundtrip": PAPER_XML_ROUNDTRIP,
    "paper_xml_sections": PAPER_XML_SECTIONS,
    "paper_xml_parts": PAPER_XML_PARTS,
    "table_heading_lists": TABLE_HEADING_LISTS,
})


# --- token frequency -------------------------------------------------------------------

TOKEN_FREQUENCY = f"""
WITH d AS (SELECT doc_id, CAST(2000 + doc_id % 25 AS INTEGER) AS year, lower(text) AS lc FROM documents),
totals AS (SELECT year, count(*) AS docs FROM d WHERE lc IS NOT NULL GROUP BY year),
t AS (SELECT DISTINCT doc_id, year, unnest(regexp_extract_all(lc, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM d),
w AS (SELECT unnest({_list(sorted(catalog.TOKEN_WORDS))}) AS word),
h AS (SELECT year, word, count(*) AS n_docs FROM t WHERE word IN (SELECT word FROM w) GROUP BY year, word)
SELECT h.year, h.word, h.n_docs, round(h.n_docs / totals.docs, 6) AS freq FROM h JOIN totals USING (year)
"""

_ORACLE_SECTIONS.update({"token_frequency": TOKEN_FREQUENCY})


ANSWER_PROMPTS = f"""
WITH {_ARTICLES}
SELECT doi, 6 AS n_messages,
  CASE WHEN n < 5 THEN NULL
       WHEN contains(' ' || abs_all || ' ', ' the ') THEN 'English'
       WHEN contains(' ' || abs_all || ' ', ' und ') OR contains(' ' || abs_all || ' ', ' der ') THEN 'German, mostly'
       ELSE 'Spanish or French.' END AS response,
  CASE WHEN n < 5 THEN 'ValueError: abstract too short' END AS error
FROM x
"""

_ORACLE_SECTIONS.update({"answer_prompts": ANSWER_PROMPTS})


SCREENING_REPORT = f"""
WITH s AS ({SCREEN_ABSTRACTS})
SELECT CASE WHEN error IS NOT NULL THEN 'failed' WHEN language IS NULL THEN 'pending' ELSE 'analysed' END AS status,
  count(*) AS n
FROM s GROUP BY 1
"""

_ORACLE_SECTIONS.update({"screening_report": SCREENING_REPORT})
