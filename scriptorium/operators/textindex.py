"""An index of three-letter pieces for substring and regex search over many texts.

An index folder grows by generations; adding records makes one and touches no
other.  A generation holds its records as they came, numbered, and the postings:
for every piece (gram) of a lower-cased text and every block of ``BLOCK``
records the sorted numbers of those that have it.  Records are moved once, to
their block; grams are gathered where the block is, so no gram is shuffled, and
a gram that every text has is as many rows as there are blocks.  Postings are
sorted by gram, and Parquet codes the sorted numbers as differences and lets a
search skip the pages of all other grams.

A search names, per question, alternatives of literals that a matching text must
hold.  The postings of their grams are read and nothing else; in each block the
lists are intersected from the shortest on.  What is left are candidates: the
caller puts the question itself to their texts, so results equal those of a
scan.  A question without a literal of three letters has every record as
candidate.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import lexical, search
from scriptorium.sources import generations

GRAM = 3
BLOCK = 1 << 13
ID = "_id"

Alternatives = Sequence[Sequence[str]]


def hay_of(fields: Sequence[str]) -> Column:
    """The text a search looks at: the fields, lower-cased, a space between them."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))


def grams_of(literal: str) -> set[str]:
    return {literal[i : i + GRAM] for i in range(len(literal) - GRAM + 1)}


def _postings(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    block = F.shiftright(ID, BLOCK.bit_length() - 1).alias("block")
    narrow = records.select(block, F.col(ID).bitwiseAND(BLOCK - 1).cast("int").alias("low"), hay_of(fields).alias("hay"))
    grams = F.array_distinct(F.regexp_extract_all("hay", F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))
    found = narrow.repartition("block").select("block", "low", F.explode(grams).alias("gram"))
    return found.groupBy("block", "gram").agg(F.array_sort(F.collect_list("low")).alias("lows"))


def add_records(records: DataFrame, root: str, fields: Sequence[str]) -> None:
    """Add records to the index below ``root``; ``fields`` are the text columns that searches look at."""
    spark = records.sparkSession
    standing = generations.live(spark, root)
    if any(g.note["fields"] != list(fields) for g in standing):
        raise ValueError(f"{root} is an index of other fields")

    def save(path: str) -> None:
        records.withColumn(ID, F.monotonically_increasing_id()).write.parquet(f"{path}/records")
        held = spark.read.schema(records.schema.add(ID, "long")).parquet(f"{path}/records")
        writer = _postings(held, fields).sortWithinPartitions("gram", "block").write
        # sorted numbers are stored as differences
        writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").parquet(f"{path}/postings")

    generations.add(spark, root, save, {"fields": list(fields), "schema": records.schema.simpleString()})


def _records(spark: SparkSession, g: generations.Generation) -> DataFrame:
    return spark.read.parquet(f"{g.path}/records")


def all_records(spark: SparkSession, root: str) -> DataFrame:
    """Every record of the index, without reading postings."""
    frames = [_records(spark, g).drop(ID) for g in _standing(spark, root)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _standing(spark: SparkSession, root: str) -> list[generations.Generation]:
    found = generations.live(spark, root)
    if not found:
        raise FileNotFoundError(f"no index at {root}")
    return found


def _asked_ids(spark: SparkSession, g: generations.Generation, needs: list[tuple[int, int, str, int]]) -> DataFrame:
    """(id, asked): records that hold all grams of an alternative, with the questions they are candidates of."""
    wanted = spark.createDataFrame(needs, "question int, alternative int, gram string, n_grams int")
    grams = sorted({gram for _, _, gram, _ in needs})
    lists = spark.read.schema("block long, gram string, lows array<int>").parquet(f"{g.path}/postings").where(F.col("gram").isin(grams))
    # as many rows as the questions have grams
    gathered = lists.join(F.broadcast(wanted), "gram").groupBy("question", "alternative", "block").agg(
        F.max("n_grams").alias("n_grams"), F.array_sort(F.collect_list(F.struct(F.size("lows").alias("n"), "lows"))).alias("found")
    )
    common = F.expr("aggregate(slice(found, 2, size(found)), found[0].lows, (held, x) -> array_intersect(held, x.lows))")
    held = gathered.where(F.size("found") == F.col("n_grams")).select("question", "block", F.explode(common).alias("low"))
    number = F.shiftleft("block", BLOCK.bit_length() - 1) + F.col("low")
    return held.groupBy(number.alias(ID)).agg(F.collect_set("question").alias("asked"))


def candidates(spark: SparkSession, root: str, questions: Mapping[int, Alternatives]) -> DataFrame:
    """The records that may answer one of the questions, with the numbers of these (``asked``).

    A question is a list of alternatives, each a list of literals; a record is a
    candidate if it has all grams of all literals of one alternative.
    """
    needs: list[tuple[int, int, str, int]] = []
    open_ended: list[int] = []
    for number, alternatives in questions.items():
        sets = [set().union(*map(grams_of, literals)) for literals in alternatives]
        if not sets or not all(sets):
            open_ended.append(number)
            continue
        needs += [(number, k, gram, len(grams)) for k, grams in enumerate(sets) for gram in sorted(grams)]
    out = None
    always = F.array(*[F.lit(n) for n in open_ended]).cast("array<int>")
    for g in _standing(spark, root):
        rows = _records(spark, g)
        if needs:
            asked = _asked_ids(spark, g, needs)
            rows = rows.join(asked, ID, "left" if open_ended else "inner").withColumn(
                "asked", F.concat(always, F.coalesce("asked", F.array().cast("array<int>")))
            )
        else:
            rows = rows.withColumn("asked", always)
        rows = rows.drop(ID)
        out = rows if out is None else out.unionByName(rows)
    return out


def search_papers(spark: SparkSession, root: str, text: str, **limits) -> DataFrame:
    """``search.search_papers`` over an index: same rows, but only records with the terms' grams are read.

    The fields are those of the index; ``limits`` are the other arguments.
    """
    found = candidates(spark, root, {0: [text.lower().split()]}).drop("asked")
    return search.search_papers(found, text, fields=_standing(spark, root)[0].note["fields"], **limits)


# Characters that end a literal in a regex, besides quantifiers (fixed values of the pattern syntax).
SPECIAL = set("^$.")
QUANTIFIERS = set("?*{")


def literals_of(pattern: str) -> list[list[str]]:
    """Alternatives of literals that every text matched by a Java regex must hold; [[]] where none is known.

    Plain characters and escaped punctuation count; groups, classes and other
    escapes end a literal; a quantified character is left out, or ends its
    literal where it occurs once at least.  Flags and quoted parts say nothing.
    """
    if "(?" in pattern or r"\Q" in pattern:
        return [[]]
    alternatives: list[list[str]] = [[]]
    literal, depth, i = "", 0, 0

    def end(cut: int = 0) -> str:
        kept = literal[: len(literal) - cut]
        if kept:
            alternatives[-1].append(kept)
        return ""

    plain = False  # whether the last item is the last character of ``literal``
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            step = 2
            escaped = pattern[i + 1 : i + 2]
            if depth == 0 and escaped and not escaped.isalnum():
                literal, plain = literal + escaped, True
            else:
                if escaped in {"p", "P", "x", "u", "k", "N"} and pattern[i + 2 : i + 3] in {"{", "<"}:
                    step = 2 + re.search(r"[}>]|$", pattern[i + 2 :]).end()
                elif escaped and escaped in "pPxu0c":
                    return [[]]  # spelt-out characters: not worth knowing
                if depth == 0:
                    literal, plain = end(), False
            i += step
            continue
        if c == "[":
            # a class: to its closing bracket, nested ones and escapes included
            level, i = 1, i + 1
            if pattern[i : i + 1] == "^":
                i += 1
            first = True
            while i < len(pattern) and level:
                d = pattern[i]
                if d == "\\":
                    i += 1
                elif d == "[":
                    level += 1
                elif d == "]" and not first:
                    level -= 1
                first = False
                i += 1
            if depth == 0:
                literal, plain = end(), False
            continue
        if c in "()":
            depth += 1 if c == "(" else -1
            if c == "(" and depth == 1:
                literal, plain = end(), False
        elif depth == 0:
            if c == "|":
                literal, plain = end(), False
                alternatives.append([])
            elif c in QUANTIFIERS or c == "+":
                optional = c != "+"
                literal = end(1 if optional and plain else 0)
                plain = False
                if c == "{":
                    i = pattern.find("}", i)
                    if i < 0:
                        return [[]]
            elif c in SPECIAL:
                literal, plain = end(), False
            else:
                literal, plain = literal + c, True
        i += 1
    end()
    return alternatives


def term_frequency(
    spark: SparkSession, root: str, words: Sequence[str] = (), year_col: str = "year", labelled: Mapping[str, str] | None = None
) -> DataFrame:
    """``lexical.term_frequency`` of an index of one text column: each pattern is put to its candidates only."""
    table = lexical.word_table(words, labelled)
    column = _standing(spark, root)[0].note["fields"]
    if len(column) != 1:
        raise ValueError("term frequencies are of one text column")
    texts = all_records(spark, root).where(F.col(year_col).isNotNull() & F.col(column[0]).isNotNull())
    totals = texts.groupBy(F.col(year_col).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n_docs"))
    found = candidates(spark, root, {i: literals_of(p) for i, p, _ in table})
    hay = F.lower(F.col(column[0]))
    matches = [F.count_if(F.array_contains("asked", i) & hay.rlike(p)) for i, p, _ in table]
    hits = found.groupBy(F.col(year_col).cast("int").alias("year")).agg(F.array(*matches).alias("found"))
    none = F.array_repeat(F.lit(0).cast("long"), F.lit(len(table)))
    rows = totals.join(hits, "year", "left").select("year", "n_docs", F.coalesce("found", none).alias("hits"))
    # years whose texts are all missing stay, without a frequency
    years = all_records(spark, root).select(F.col(year_col).cast("int").alias("year")).where(F.col("year").isNotNull()).distinct()
    empty = years.join(totals, "year", "left_anti").select("year", F.lit(0).cast("long").alias("n_docs"), none.alias("hits"))
    return lexical.frequency_of_hits(rows.unionByName(empty), words, labelled)
