"""Section pipeline: clean, structure, merge and classify the sections of papers.

Input: one row per parsed section ``item_key, pos, heading, num, text,
publication_refs, figure_refs, table_refs`` (``pos`` orders sections inside a
paper).  Output: one row per merged main section with its class.

The sequential per-paper walk of the original (a dict of main sections that
sub-sections are appended to) is one fold per paper over its sections, gathered
in order by one aggregate after one shuffle by ``item_key``:

* the rows are cut at the main ones, so each part has one main section;
* parts are sorted by key and cut where it changes; a main key met again
  *replaces* the earlier part in the numbered and roman schemes but keeps the
  place of its first appearance; the heading scheme *appends*;
* the text fold is one string piece per row, joined in order.

Every step takes time linear in the paper's sections (but for the sorts), no
window is used, and texts are only referred to until they are joined.  A paper
is held as one row, as the corpus it is exported to holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

KEY = "item_key"
REF_COLS = ("publication_refs", "figure_refs", "table_refs")

# Section classes and the title patterns of the rules, applied
# in this order (later rules override earlier ones).
INTRODUCTION = "introduction"
RELATED_WORK = "related work"
METHOD = "method"
EVALUATION = "evaluation"
CONCLUSION = "conclusion"
SECTION_TYPES = (INTRODUCTION, RELATED_WORK, METHOD, EVALUATION, CONCLUSION)
INTRO_PATTERN = "introduction|background"
RELATED_PATTERN = "related work|previous work|literature review"
CONCLUSION_PATTERN = "discussion|conclusion|future work"
EVALUATION_PATTERN = "experiments|results|validation|evaluation"
METHOD_PATTERN = "method"
# Heading marks of the numbering schemes.
INTRO_HEADING = "introduction"
INITIAL_TITLE = "Introduction"
ROMAN_MAIN = r"^(?:ix|iv|v?i{0,3})\."
ROMAN_FIRST = "i. "



def flag_duplicates(df: DataFrame, keys=("heading", "num"), out_col: str = "is_duplicated") -> DataFrame:
    """True on rows whose (paper, keys) occurs more than once in the paper."""
    return df.withColumn(out_col, F.count(F.lit(1)).over(Window.partitionBy(KEY, *keys)) > 1)


def drop_near_duplicates(sections: DataFrame, n_word_chars: int | None = None) -> DataFrame:
    """In each group of equal raw (heading, num) keep the longest text (first on
    ties) and drop the rows whose word characters equal its own (the first
    ``n_word_chars`` only, if given: the original's rule takes 100).

    All windows share one ordering (length desc, pos), hence one sort.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = tx.word_key(text, n_word_chars)
    if n_word_chars is None:
        key = F.sha2(key, 256)  # a whole text is compared by its digest, so windows do not carry it twice
    sections = sections.select("*", F.length(text).alias("_len"), key.alias("_wkey"))
    by_len = Window.partitionBy(KEY, "heading", "num").orderBy(F.col("_len").desc(), F.col("pos").asc())
    whole = by_len.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flagged = sections.select(
        "*",
        F.count(F.lit(1)).over(whole).alias("_n"),
        F.first("pos").over(whole).alias("_lpos"),
        F.first("_wkey").over(whole).alias("_lkey"),
    )
    keep = (F.col("_n") == 1) | (F.col("pos") == F.col("_lpos")) | (F.col("_wkey") != F.col("_lkey"))
    return flagged.where(keep).drop("_n", "_len", "_lpos", "_lkey", "_wkey")


def section_rows(sections: DataFrame, n_word_chars: int | None = None) -> DataFrame:
    """Per section one struct ``row``, led by ``pos``: cleaned values, and each
    test of the numbering schemes, worked out once.

    NULL becomes "" (refs: []), heading and num are stripped of white space; the
    raw heading and num stay as the key of near duplicates.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = tx.word_key(text, n_word_chars)
    empty = F.array().cast("array<string>")
    base = sections.select(
        KEY, "pos", F.col("heading").alias("raw_heading"), F.col("num").alias("raw_num"),
        tx.strip(F.coalesce("heading", F.lit(""))).alias("heading"),
        tx.strip(F.coalesce("num", F.lit(""))).alias("num"),
        text.alias("text"), F.length(text).alias("len"),
        (key if n_word_chars else F.sha2(key, 256)).alias("word_key"),
        *[F.coalesce(F.col(c), empty).alias(c) if c in sections.columns else empty.alias(c) for c in REF_COLS],
    )
    num, heading = F.col("num"), F.col("heading")
    tests = base.select(
        "*",
        F.lower(heading).alias("title"),
        num.rlike(r"^\p{Nd}+$").alias("plain_number"),
        num.rlike(r"^\p{Nd}+\.$").alias("dotted_number"),
        F.lower(heading).rlike(ROMAN_MAIN).alias("roman"),
        (tx.is_upper(heading) & (heading != "")).alias("upper"),
        F.coalesce((heading != "") & tx.is_upper(tx.first_word(heading)), F.lit(False)).alias("capitals"),
    )
    after_dot = F.expr("substring(heading, instr(heading, '.') + 1)")
    roman_num = F.concat(tx.roman_to_int(F.substring_index("heading", ".", 1)).cast("string"), F.lit("."))
    marked = tests.select(
        "*",
        num.isin("1", "1.").alias("one"),
        F.col("title").startswith(ROMAN_FIRST).alias("roman_first"),
        F.col("title").contains(INTRO_HEADING).alias("intro"),
        F.when(F.col("roman"), roman_num).alias("roman_num"),
        F.when(F.col("roman"), F.lower(after_dot)).alias("roman_title"),
        F.when(F.col("capitals"), F.lower(tx.leading_upper_words(heading))).alias("capitals_title"),
    )
    return marked.select(KEY, F.struct(*[c for c in marked.columns if c != KEY]).alias("row"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _indexes(items: Column) -> Column:
    return F.sequence(F.lit(0), F.size(items) - 1)


def _first_index(items: Column, test) -> Column:
    """Index of the first item that passes; NULL if none does."""
    return F.get(F.filter(_indexes(items), lambda i: test(F.get(items, i), i)), F.lit(0))


def _cut(items: Column, starts: Column) -> Column:
    """The items from each of ``starts`` (ascending indexes) up to the next one."""
    return F.transform(starts, lambda s, j: F.slice(items, s + 1, F.coalesce(F.get(starts, j + 1), F.size(items)) - s))


def _runs(items: Column, fields: tuple[str, ...], body) -> Column:
    """``body`` of each run of neighbours that agree in ``fields``."""

    def begins(i: Column) -> Column:
        here, before = F.get(items, i), F.get(items, i - 1)
        same = F.lit(True)
        for f in fields:
            same = same & here[f].eqNullSafe(before[f])
        return (i == 0) | ~same

    return _let(F.filter(_indexes(items), begins), lambda starts: F.transform(_cut(items, starts), body))


def without_near_duplicates(rows: Column) -> Column:
    """The rows of a paper, in order, by the rule of ``drop_near_duplicates``."""

    def kept(group: Column) -> Column:
        def unlike_longest(longest: Column) -> Column:
            keep = F.filter(group, lambda g: (g["pos"] == longest["pos"]) | (g["row"]["word_key"] != longest["row"]["word_key"]))
            return F.transform(keep, lambda g: g["row"])

        return _let(F.get(group, F.lit(0)), unlike_longest)

    keyed = F.transform(
        rows,
        lambda r: F.struct(
            r["raw_heading"].alias("heading"), r["raw_num"].alias("num"), (-r["len"]).alias("shorter"), r["pos"].alias("pos"), r.alias("row")
        ),
    )
    return F.array_sort(_let(F.array_sort(keyed), lambda k: F.flatten(_runs(k, ("heading", "num"), kept))))


def section_scheme(rows: Column) -> Column:
    """Numbering scheme of a paper: N (numbers), R (roman), C (capitals), H (headings).

    ``no_dot``: the first section 1 is numbered without a dot.  ``first_title``:
    title of the sections before the first main one.
    """
    strategy = (
        F.when(F.exists(rows, lambda r: r["one"]), F.lit("N"))
        .when(F.exists(rows, lambda r: r["roman_first"]), F.lit("R"))
        .when(F.exists(rows, lambda r: r["upper"]), F.lit("C"))
        .otherwise(F.lit("H"))
    )
    first_one = F.get(F.filter(rows, lambda r: r["one"]), F.lit(0))
    first_title = F.when(F.exists(rows, lambda r: r["intro"]), F.lit("")).otherwise(F.lit(INITIAL_TITLE))
    return F.struct(strategy.alias("is"), (first_one["num"] == "1").alias("no_dot"), first_title.alias("first_title"))


def main_sections(rows: Column, scheme: Column) -> Column:
    """The rows cut at the main ones: (num, title, at, main, rows).

    What stands before the first main row is a part of its own, ``main`` false.
    """
    s = scheme["is"]

    def is_main(r: Column) -> Column:
        number = F.when(scheme["no_dot"], r["plain_number"]).otherwise(r["dotted_number"])
        return F.when(s == "N", number).when(s == "R", r["roman"]).when(s == "C", r["capitals"]).otherwise(r["heading"] != "")

    def part(rows_of: Column, at: Column, nth: Column, main: Column) -> Column:
        head = F.get(rows_of, F.lit(0))
        num = F.when(s == "R", head["roman_num"]).when(s == "C", F.concat(nth.cast("string"), F.lit("."))).otherwise(head["num"])
        title = F.when(s == "R", head["roman_title"]).when(s == "C", head["capitals_title"]).otherwise(head["title"])
        return F.struct(
            F.when(main, num).otherwise(F.lit("")).alias("num"),
            F.when(main, title).otherwise(scheme["first_title"]).alias("title"),
            at.alias("at"), main.alias("main"), rows_of.alias("rows"),
        )

    def parts(mains: Column) -> Column:
        # 1 if rows stand before the first main one
        early = F.when(F.coalesce(F.get(mains, F.lit(0)), F.lit(1)) > 0, F.lit(1)).otherwise(F.lit(0))
        starts = F.concat(F.array_repeat(F.lit(0), early), mains)
        return _let(F.struct(early.alias("early"), starts.alias("starts")), lambda c: F.transform(
            _cut(rows, c["starts"]),
            lambda rows_of, j: part(rows_of, F.get(c["starts"], j), j - c["early"], j >= c["early"]),
        ))

    return _let(F.filter(_indexes(rows), lambda i: is_main(F.get(rows, i))), parts)


def merged_section(parts: Column, scheme: Column) -> Column:
    """The main section of the parts that share a key: (at, heading, num, text, refs).

    The last part replaces the earlier ones in the numbered and roman schemes;
    the section keeps the place of the first.
    """
    s = scheme["is"]

    def kind(r: Column, i: Column, part: Column) -> Column:
        return (
            F.when(part["main"] & (i == 0), F.lit("section"))
            .when(s == "N", F.when((r["num"] != "") & r["num"].startswith(part["num"]), F.lit("subsection")).otherwise(F.lit("")))
            .when(s == "H", F.lit(""))
            .otherwise(F.lit("subsection"))
        )

    def piece(row: Column, after_text: Column) -> Column:
        """What a row adds: sections their text, sub-sections an underlined title and
        their text, rows of kind '' extend the line before and add their text."""
        r, text = row["row"], row["row"]["text"]
        sep = F.when(after_text, F.lit("\n")).otherwise(F.lit(""))
        then_text = F.when(text != "", F.concat(F.lit("\n"), text)).otherwise(F.lit(""))
        title = F.concat(r["num"], F.lit(" "), r["heading"])
        return (
            F.when(row["kind"] == "section", F.when(text != "", F.concat(sep, text)).otherwise(F.lit("")))
            .when(row["kind"] == "subsection", F.concat(sep, F.lit("\n"), tx.underline(title), then_text))
            .otherwise(F.concat(r["heading"], F.lit(" "), text, then_text))
        )

    def values(rows: Column, name: str) -> Column:
        return F.transform(rows, lambda r: r["row"][name])

    def merged(rows: Column) -> Column:
        first_text = _first_index(rows, lambda r, i: (r["kind"] != "section") | (r["row"]["text"] != ""))
        text = _let(first_text, lambda f: F.array_join(F.transform(rows, lambda r, i: piece(r, F.coalesce(i > f, F.lit(False)))), ""))
        head = F.get(parts, F.lit(0))
        return F.struct(
            head["at"].alias("at"), head["title"].alias("heading"), head["num"].alias("num"), text.alias("text"),
            *[F.flatten(values(rows, c)).alias(c) for c in REF_COLS],
        )

    current = F.when(s.isin("N", "R"), F.slice(parts, F.size(parts), F.lit(1))).otherwise(parts)
    of_part = lambda p: F.transform(p["rows"], lambda r, i: F.struct(kind(r, i, p).alias("kind"), r.alias("row")))
    return _let(F.flatten(F.transform(current, of_part)), merged)


def section_classes(titles: Column) -> Column:
    """Class of every merged section of a paper from the lower-case titles, then carried forward.

    Rules (later override earlier): the first title matching introduction/
    background (else the first section) is the introduction; related work;
    conclusion; evaluation.  Untyped titles containing 'method' are methods;
    if there is none, the section after the introduction becomes the method
    whatever it was.  Classes are then carried forward until the first
    conclusion; sections after it keep their own class.
    """

    def own(intro: Column) -> Column:
        by_title = F.transform(
            titles,
            lambda t, i: F.when(t.rlike(EVALUATION_PATTERN), F.lit(EVALUATION))
            .when(t.rlike(CONCLUSION_PATTERN), F.lit(CONCLUSION))
            .when(t.rlike(RELATED_PATTERN), F.lit(RELATED_WORK))
            .when(i == intro, F.lit(INTRODUCTION))
            .when(t.contains(METHOD_PATTERN), F.lit(METHOD))
            .otherwise(F.lit("")),
        )

        def with_method(classes: Column) -> Column:
            second = F.transform(classes, lambda c, i: F.when(i == intro + 1, F.lit(METHOD)).otherwise(c))
            return F.when(F.array_contains(classes, METHOD), classes).otherwise(second)

        return _let(by_title, with_method)

    def carried(classes: Column) -> Column:
        def spread(starts: Column) -> Column:
            before = F.array_repeat(F.lit(""), F.coalesce(F.get(starts, F.lit(0)), F.size(classes)))
            each = F.transform(_cut(classes, starts), lambda run: F.transform(run, lambda c: F.get(run, F.lit(0))))
            return F.concat(before, F.flatten(each))

        def until(c: Column) -> Column:
            last = F.coalesce(c["conclusion"], F.size(classes))
            return F.transform(classes, lambda own, i: F.when(i > last, own).otherwise(F.get(c["filled"], i)))

        filled = _let(F.filter(_indexes(classes), lambda i: F.get(classes, i) != ""), spread)
        conclusion = _first_index(classes, lambda c, i: c == CONCLUSION)
        return _let(F.struct(filled.alias("filled"), conclusion.alias("conclusion")), until)

    intro = F.coalesce(_first_index(titles, lambda t, i: t.rlike(INTRO_PATTERN)), F.lit(0))
    return _let(_let(intro, own), carried)


def paper_sections(rows: Column) -> Column:
    """The classified main sections of one paper, an array of structs, from its rows in order."""

    def of_scheme(kept: Column, scheme: Column) -> Column:
        by_key = F.array_sort(main_sections(kept, scheme))
        return F.array_sort(_let(by_key, lambda parts: _runs(parts, ("num", "title"), lambda group: merged_section(group, scheme))))

    def classified(sections: Column) -> Column:
        titles = F.transform(sections, lambda x: F.lower(x["heading"]))
        return _let(_let(titles, section_classes), lambda types: F.transform(sections, lambda x, i: F.struct(
            i.alias("sec_idx"), *[x[c].alias(c) for c in ("heading", "num", "text", *REF_COLS)], F.get(types, i).alias("type")
        )))

    return _let(_let(without_near_duplicates(rows), lambda kept: _let(section_scheme(kept), lambda s: of_scheme(kept, s))), classified)


def classify_sections(sections: DataFrame, n_word_chars: int | None = None) -> DataFrame:
    """The whole pipeline: near duplicates, cleaning, scheme, tree, merge, classes.

    One row per merged main section, ``sec_idx`` its place in the paper (first
    appearance).  One shuffle by paper and one aggregate.  ``n_word_chars``: see
    ``drop_near_duplicates``.
    """
    papers = section_rows(sections, n_word_chars).groupBy(KEY).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return papers.select(KEY, F.inline(paper_sections(F.col("rows"))))


def _ordered_flatten(value: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(value).alias("v"))))
    return F.flatten(F.transform(items, lambda x: x["v"]))


def merge_section_list(sections: DataFrame, group_cols=(KEY,)) -> DataFrame:
    """Merge each group's sections (ordered by ``pos``) under its first heading.

    Text: the first section's text, then for each further section its
    underlined ``num heading`` (when it has a heading) and its text; refs are
    concatenated in order.
    """
    w = Window.partitionBy(*group_cols).orderBy("pos")
    first = F.row_number().over(w) == 1
    t = F.coalesce(F.col("text"), F.lit(""))
    h = F.coalesce(F.col("heading"), F.lit(""))
    n = F.coalesce(F.col("num"), F.lit(""))
    sub = F.when(n != "", F.concat(n, F.lit(" "), h)).otherwise(h)
    empty = F.array().cast("array<string>")
    head_el = F.when(~first & (h != ""), F.array(tx.underline(sub))).otherwise(empty)
    text_el = F.when(t != "", F.array(t)).otherwise(empty)
    rows = sections.select(
        *group_cols, "pos", h.alias("heading"), n.alias("num"), F.concat(head_el, text_el).alias("_els"),
        *[F.coalesce(F.col(c), empty).alias(c) for c in REF_COLS if c in sections.columns],
    )
    refs = [c for c in REF_COLS if c in sections.columns]
    return rows.groupBy(*group_cols).agg(
        F.min_by("heading", "pos").alias("heading"),
        F.min_by("num", "pos").alias("num"),
        F.array_join(_ordered_flatten("_els"), "\n").alias("text"),
        *[_ordered_flatten(c).alias(c) for c in refs],
    )


def pretty_text(sections: DataFrame, group_cols=(KEY,), order_col: str = "sec_idx") -> DataFrame:
    """``num | HEADING [type]`` + newline + text per section, joined by a ruler line."""
    typ = F.coalesce(F.col("type"), F.lit(""))
    title = F.concat(F.col("num"), F.lit(" | "), F.upper("heading"), F.when(typ != "", F.concat(F.lit(" ["), typ, F.lit("]"))).otherwise(F.lit("")))
    block = F.concat(title, F.lit("\n"), F.coalesce(F.col("text"), F.lit("")))
    items = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), block.alias("v"))))
    return sections.groupBy(*group_cols).agg(
        F.array_join(F.transform(items, lambda x: x["v"]), "\n\n==============================\n\n").alias("pretty_text")
    )
