"""I-Match document fingerprints, on DataFrame functions only.

A term is a lower-cased run of letters and digits.  Terms whose inverse
document frequency ln(documents / documents with the term) lies in a band form
the lexicon.  A document's distinct lexicon terms are sorted, and for each of
several randomised subsets of the lexicon those that belong to it are hashed;
the subsets keep a quarter to a 1024th of the lexicon, so documents of any
length have subsets that hold only a few of their terms.  The likeness of two
fingerprints is the share of equal hashes among the subsets in which either has
a term.

The lexicon is a table: (term, the subsets it belongs to).  Texts and edited
texts are exploded into terms once, joined with it, and the terms that stay are
gathered per document.  The lexicon is written first, so Spark knows its size
before it plans: below the session's broadcast threshold the terms stay where
their text is, beyond it they are joined by term.

Defined cases: null texts count as empty; a document without lexicon terms is
fingerprinted by the hash of all its distinct terms, or of its text where it
has none; rows that repeat doc_id and text are one document, its result is
repeated per row; null doc_ids sort last; ties of doc_id sort by text hash; the
document after the last is the first, and a single document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import staged, text_or_empty

MIN_IDF = 2.0
MAX_IDF = 5.5
TERM = r"[\p{L}\p{N}]+"
# one in so many lexicon terms belongs to each subset
RATES = (4, 8) + (16,) * 2 + (32,) * 3 + (64,) * 4 + (128,) * 4 + (256,) * 4 + (512,) * 3 + (1024,) * 2
# copies of a document that one piece of its result stands for
COPIES = 1024


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def in_subsets(words: DataFrame) -> DataFrame:
    """(term, subsets): bit k of ``subsets`` says whether the term belongs to subset k."""
    subsets = F.lit(0).cast("long")
    for k, rate in enumerate(RATES):
        subsets = subsets + F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(rate)) == 0, F.lit(1 << k)).otherwise(0)
    return words.select("term", subsets.alias("subsets"))


def lexicon(docs: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """Terms whose document frequency over the whole corpus lies in the band; at least two documents."""
    total = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = F.log(F.lit(float(max(total, 1))) / F.col("df")).between(min_idf, max_idf) & (F.col("df") >= 2)
    return staged(in_subsets(counts.where(band)), "lexicon")


def fingerprints(rows: DataFrame, keys: list[str], carried: list[str], texts: dict[str, str], words: DataFrame) -> DataFrame:
    """One row per distinct ``keys``: ``carried`` columns, ``copies`` (rows of the key) and fingerprints.

    ``texts`` maps a text column to the name of its fingerprint: an array with
    a hash per subset, null where the subset has no term; its last element is
    set only where no subset has a term.  Rows of one key must be equal.
    """
    names = list(texts.values())
    rows = rows.withColumns({f"{n}_terms": terms(F.col(c)) for c, n in texts.items()})
    rest = {
        f"{n}_rest": F.when(F.size(f"{n}_terms") > 0, F.xxhash64(F.array_sort(f"{n}_terms"))).otherwise(F.xxhash64(c))
        for c, n in texts.items()
    }
    # each text's terms under its place, and under -1 one row that holds what is carried along
    lists = [F.struct(F.lit(i).alias("place"), F.col(f"{n}_terms").alias("found")) for i, n in enumerate(names)]
    lists.append(F.struct(F.lit(-1).alias("place"), F.array(F.lit(None).cast("string")).alias("found")))
    kept = [*carried, *rest]
    dealt = rows.withColumns(rest).select(*keys, *kept, F.explode(F.array(*lists)).alias("part"))
    dealt = dealt.select(*keys, *kept, "part.place", F.explode("part.found").alias("term"))
    own = F.col("place") == -1
    dealt = dealt.select(*keys, *[F.when(own, F.col(c)).alias(c) for c in kept], "place", "term")
    hits = dealt.join(words.where("subsets <> 0"), "term", "left").where(own | F.col("subsets").isNotNull())
    term = F.struct("term", "subsets")
    gathered = hits.groupBy(*keys).agg(
        F.count(F.when(own, True)).alias("copies"),
        *[F.max(c).alias(c) for c in kept],
        *[F.collect_set(F.when(F.col("place") == i, term)).alias(f"{n}_kept") for i, n in enumerate(names)],
        *[F.coalesce(F.bit_or(F.when(F.col("place") == i, F.col("subsets"))), F.lit(0)).alias(f"{n}_used") for i, n in enumerate(names)],
    )
    gathered = gathered.withColumns({f"{n}_kept": F.array_sort(f"{n}_kept") for n in names})
    bits = F.array(*[F.lit(1 << k).cast("long") for k in range(len(RATES))])

    def fingerprint(n: str) -> Column:
        def digest(bit: Column) -> Column:
            chosen = F.filter(f"{n}_kept", lambda t: t["subsets"].bitwiseAND(bit) != 0)
            return F.when(F.col(f"{n}_used").bitwiseAND(bit) != 0, half(F.xxhash64(F.transform(chosen, lambda t: t["term"]))))

        return F.concat(F.transform(bits, digest), F.array(F.when(F.col(f"{n}_used") == 0, half(F.col(f"{n}_rest")))))

    return gathered.select(*keys, "copies", *carried, *[fingerprint(n).alias(n) for n in names])


def half(h: Column) -> Column:
    """The upper 32 bits of a 64-bit hash."""
    return F.shiftright(h, 32).cast("int")


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the places where either fingerprint has one."""
    pairs = F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))
    used = F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    same = F.filter(pairs, lambda p: p["x"] == p["y"])
    return F.size(same) / F.size(used).cast("double")


def shown(name: str) -> Column:
    """Eight hex digits per subset, dots where it has no term."""
    digits = F.transform(name, lambda h: F.coalesce(F.lower(F.substring(F.lpad(F.hex(h), 16, "0"), 9, 8)), F.lit("." * 8)))
    return F.array_join(digits, "")


def following(docs: DataFrame) -> DataFrame:
    """(id, th, next_id, next_th, given): each distinct document's successor and the characters it gives.

    Documents are dealt by ranges of (doc_id, text hash); within a range the
    successor is the next row, and the ranges' first rows are linked over the
    ranges.  Only keys and lengths move here.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_last(), F.col("th").asc()]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("doc_id", "th", F.floor(F.length("text") / 4).alias("given")).distinct()
    dealt = staged(keys.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "document-order")
    key = F.struct("doc_id", "th")
    by_order = Window.partitionBy("part").orderBy(*order)
    rows = dealt.withColumns({"after": F.lead(key).over(by_order), "place": F.row_number().over(by_order)})
    heads = rows.where("place = 1").select("part", key.alias("head"))
    parts = Window.orderBy("part")
    first = F.first("head").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(parts), first).alias("next_head"))
    linked = rows.join(heads, "part").withColumn("after", F.coalesce("after", "next_head"))
    return linked.select("doc_id", "th", "after.doc_id", "after.th", "given").toDF(
        "doc_id", "th", "next_id", "next_th", "given"
    )


def document_key(doc_id: str, text_hash: str) -> Column:
    """One value for a document, never null: equal where doc_id (null included) and text hash are."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), F.hex(text_hash))


def fingerprint_edits(docs: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """Fingerprint every text and its edited text, and compare with it and with the next document.

    The edited text replaces the last floor(n_chars / 4) characters by the
    first as many (or all) of the next document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    words = lexicon(docs, min_idf, max_idf)
    docs = docs.withColumn("th", F.xxhash64("text"))
    order = staged(following(docs), "document-successors")
    links = order.select(
        F.col("doc_id"), document_key("doc_id", "th").alias("to_key"), document_key("next_id", "next_th").alias("next_key"), "given"
    )
    # both joins read the same two columns, so the texts are exchanged once; by one key, so that the
    # terms of a document are gathered in the partition its text came to
    texts = docs.select(document_key("doc_id", "th").alias("key"), "text")
    gifts = (
        texts.join(links, F.col("key") == F.col("next_key"))
        .groupBy("to_key")
        .agg(F.max(F.expr("left(text, int(given))")).alias("gift"), F.max("doc_id").alias("doc_id"))
    )
    texts = texts.join(gifts, F.col("key") == F.col("to_key")).select(
        "key",
        "doc_id",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 4)))"), "gift").alias("edited"),
    )
    texts = texts.withColumn("edited_sha256", F.sha2("edited", 256))
    names = {"text": "own", "edited": "other"}
    found = staged(fingerprints(texts, ["key"], ["doc_id", "n_chars", "edited_sha256"], names, words), "fingerprints")
    ahead = (
        found.select("key", F.col("own").alias("ahead"))
        .join(links.select("to_key", "next_key"), F.col("key") == F.col("next_key"))
        .groupBy("to_key")
        .agg(F.max("ahead").alias("ahead"))
    )
    # a row per row of the document, made in pieces so that no array grows with its copies
    found = found.withColumn("copy", F.explode(F.expr(f"sequence(1L, copies, {COPIES}L)")))
    found = found.withColumn("copy", F.explode(F.expr(f"sequence(copy, least(copies, copy + {COPIES - 1}))")))
    return found.join(ahead, F.col("key") == F.col("to_key")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown("own").alias("fingerprint"),
        shown("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "ahead").alias("near_next"),
    )
