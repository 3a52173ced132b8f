"""Personal data by bootstrapped contextual extraction, on DataFrame functions only.

Base spans (email, ip, card, phone) are found by patterns and checks and are
the seeds.  Every other token with a digit or an at-sign is a candidate
identifier.  The last two words before a token, folded, are its lexical
pattern, whatever they hold and however far they stand; the later tokens of a
seed that spans several have none.  Patterns and identifiers form a graph with counted edges; each round
scores a pattern by the weighted share of known identifiers behind it and an
identifier by the patterns before it.  Tokens behind patterns of high
confidence, with enough different seeds, are reported as kind ``context``.

Positions come from splitting a text by the pattern: a match starts where the
lengths of all pieces and matches before it end, a running sum over the
document's matches.  The expressions are written so that matching takes time
linear in the text (possessive repeats, starts only where a run starts).

Spans are code points, end exclusive, of whole texts.  Null texts count as
empty, repeated rows give repeated results, doc_id is carried and never a key;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import staged, text_or_empty, with_row_id

KINDS = ("email", "ip", "card", "phone", "context")
SPACE = r"\x20\x09-\x0D"
# The contract's patterns.  Nothing after a repeat can take what it took, so
# possessive repeats match the same; a match may start only at the start of a
# run, or where the one before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = rf"(?:\G|(?<=[{SPACE}]))[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
PATTERN_WORDS = 2
ROUNDS = 3
MIN_SEEDS = 3
CONFIDENCE = 0.8
LEAD, TRAIL = "\"'([{<", "\"')]}>.,;:!?"
CANDIDATE_KIND = len(KINDS) - 1


def last_words(piece: Column) -> Column:
    """The last words of a piece, as they stand; matched from its end, so that a long piece is not split."""
    pattern = rf"^[{SPACE}]*+([^{SPACE}]++(?:[{SPACE}]++[^{SPACE}]++){{0,{PATTERN_WORDS - 1}}}+)"
    return F.reverse(F.regexp_extract(F.reverse(piece), pattern, 1))


def matches(kind: int, pattern: str, when: Column) -> Column:
    """Array of (kind, pos, gap, context, value): each match and the last words of the piece of text before it."""
    pieces = F.split("text", pattern, -1)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(pieces.alias("piece"), found.alias("value"))

    def row(pair: Column, pos: Column) -> Column:
        context = last_words(pair["piece"]) if kind == CANDIDATE_KIND else F.lit("")
        return F.struct(
            F.lit(kind).alias("kind"),
            pos.alias("pos"),
            F.length(pair["piece"]).alias("gap"),
            context.alias("context"),
            pair["value"].alias("value"),
        )

    rows = F.filter(F.transform(pairs, row), lambda r: r["value"].isNotNull())
    return F.when(when, rows)


def valid() -> Column:
    """The checks a base match must pass; candidates pass."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    parts = F.transform(F.split("value", r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    size = F.length(digits)
    return (
        F.when(F.col("kind") == 1, small)
        .when(F.col("kind") == 2, size.between(13, 19) & F.when(size <= 19, F.call_function("luhn_check", digits)))
        .when(F.col("kind") == 3, size.between(9, 15))
        .otherwise(True)
    )


def occurrences(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the rows with a row_id, and every valid match with its position."""
    text = text_or_empty().alias("text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    digits, at = F.col("text").rlike("[0-9]"), F.col("text").contains("@")
    found = [
        matches(0, EMAIL, at),
        matches(1, IP, digits),
        matches(2, CARD, digits),
        matches(3, PHONE, F.col("text").contains("+") & digits),
        matches(CANDIDATE_KIND, CANDIDATE, digits | at),
    ]
    hits = F.flatten(F.filter(F.array(*found), lambda a: a.isNotNull()))
    rows = staged(with_row_id(source.select("doc_id", hits.alias("hits")), "row_id"), "pii-matches")
    each = rows.select("row_id", F.explode("hits").alias("hit")).select("row_id", "hit.*")
    upto = Window.partitionBy("row_id", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto).cast("long"))
    # candidates are whole words, so the words before one are those of its piece, the candidate before it, and so on
    in_order = Window.partitionBy("row_id", "kind").orderBy("pos")
    before = [F.lag(c, k).over(in_order) for k in range(PATTERN_WORDS, 0, -1) for c in ("context", "value")]
    context = F.when(F.col("kind") == CANDIDATE_KIND, last_words(F.concat_ws(" ", *before, "context"))).otherwise("")
    each = each.withColumn("context", context)
    each = each.withColumn("start", F.col("end") - F.length("value")).where(valid())
    return rows.select("row_id", "doc_id"), each.select("row_id", "kind", "start", "end", "context", "value")


def candidates(spans: DataFrame) -> DataFrame:
    """Candidate tokens without their quotes and punctuation: pattern, identifier, and whether a seed touches them.

    Later parts of a seed are left out.
    """
    lead = F.length("value") - F.length(F.ltrim("value", F.lit(LEAD)))
    inner = F.rtrim(F.ltrim("value", F.lit(LEAD)), F.lit(TRAIL))
    is_candidate = F.col("kind") == CANDIDATE_KIND
    cut = spans.withColumns(
        {
            "start": F.when(is_candidate, F.col("start") + lead).otherwise(F.col("start")),
            "value": F.when(is_candidate, inner).otherwise(F.col("value")),
        }
    ).withColumn("end", F.when(is_candidate, F.col("start") + F.length("value")).otherwise(F.col("end")))
    # a base span before or at a token's start touches it if it reaches further; one after it, if it starts inside
    by_place = Window.partitionBy("row_id").orderBy("start", "kind")
    base_end, base_start = F.when(~is_candidate, F.col("end")), F.when(~is_candidate, F.col("start"))
    reached = F.max(base_end).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    follows = F.min(base_start).over(by_place.rowsBetween(1, Window.unboundedFollowing))
    touched = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(follows < F.col("end"), F.lit(False))
    # a token after the start of a base span that reaches into it is a later part of that seed
    earlier = Window.partitionBy("row_id").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    later_part = F.coalesce(F.max(base_end).over(earlier) > F.col("start"), F.lit(False))
    words = F.regexp_extract_all(F.lower("context"), F.lit(rf"[^{SPACE}]+"), F.lit(0))
    pattern = F.array_join(F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), words), -PATTERN_WORDS, PATTERN_WORDS), " ")
    rows = cut.withColumns({"seed": touched, "later_part": later_part})
    rows = rows.where(is_candidate & ~F.col("later_part") & (F.length("value") > 0))
    return rows.select(
        "row_id", "start", "end", pattern.alias("pattern"), F.lower("value").alias("identifier"), "seed"
    )


def confident_patterns(
    tokens: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE
) -> DataFrame:
    """Patterns that the graph of patterns and identifiers makes confident.

    Edges are counted once and all stay.  A pattern's support are the different
    identifiers behind it that are seeds or have so far scored ``confidence``;
    in each round only patterns with enough support pass a score on.
    """
    counted = tokens.groupBy("pattern", "identifier").agg(
        F.count("*").alias("n"), F.max(F.col("seed").cast("double")).alias("seed")
    )
    edges = staged(counted, "pii-graph")
    scored = edges.withColumn("score", F.col("seed"))
    patterns = None
    for _ in range(rounds):
        patterns = scored.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 1)).alias("belief"),
            F.count_if((F.col("seed") > 0) | (F.col("score") >= confidence)).alias("support"),
        )
        patterns = staged(patterns.where(F.col("support") >= min_seeds).select("pattern", "belief"), "pii-patterns")
        passed = F.sum(F.col("n") * F.col("belief")) / F.sum(F.when(F.col("belief").isNotNull(), F.col("n")))
        identifiers = (
            edges.join(patterns, "pattern", "left")
            .groupBy("identifier")
            .agg(F.greatest(F.max("seed"), passed).alias("score"))
            .where(F.col("score") > 0)
        )
        scored = edges.join(identifiers, "identifier", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return patterns.where(F.col("belief") >= confidence).select("pattern")


def extract(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256 and ``found``, all reported spans by kind and start."""
    rows, spans = occurrences(docs)
    spans = staged(spans, "pii-spans")
    tokens = staged(candidates(spans), "pii-tokens")
    confident = confident_patterns(tokens, rounds, min_seeds, confidence)
    added = tokens.where(~F.col("seed")).join(confident, "pattern", "left_semi")
    everything = spans.where(F.col("kind") < CANDIDATE_KIND).select("row_id", "kind", "start", "end").unionByName(
        added.select("row_id", F.lit(CANDIDATE_KIND).alias("kind"), "start", "end")
    )
    found = everything.groupBy("row_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(CANDIDATE_KIND)],
        F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("found"),
    )
    joined = rows.join(found, "row_id", "left")
    base = F.coalesce(F.filter("found", lambda s: s["kind"] < CANDIDATE_KIND), F.array())
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:CANDIDATE_KIND]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        "found",
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def spans_text() -> Column:
    """``found`` as kind:start:end, comma-joined."""
    return F.coalesce(_joined(F.col("found")), F.lit(""))
