"""Queries on the entity-attribute-value reference library.

Name -> id lookups (library, collection, field) are the only driver actions:
each reads one row of a small dimension table.  Everything else is joins:
items x itemData x itemDataValues keyed by item and value ids, attachments by
parent item, collections by a semi join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.dates import year_anywhere
from scriptorium.sources.library import Library

# MIME types of attachments and their short names.
PDF_MIME = "application/pdf"
HTML_MIME = "text/html"
CONTENT_TYPES = {PDF_MIME: "pdf", HTML_MIME: "html"}
# Fixed value: stored attachment paths start with this 8-character prefix.
STORAGE_PREFIX = "storage:"
# User-facing field aliases.
FIELD_ALIASES = {"abstract": "abstractNote", "doi": "DOI"}
DEFAULT_LIBRARY_ID = 1


def resolve_library(lib: Library, name: str | None = "") -> int:
    """Library name -> id; ``""`` (or None) is the default library 1."""
    if not name:
        return DEFAULT_LIBRARY_ID
    row = lib.groups.where(F.col("name") == name).select("libraryID").limit(1).collect()
    if not row:
        raise ValueError(f"Library {name} not found")
    return int(row[0][0])


def resolve_collection(lib: Library, library_id: int, name: str | None) -> int | None:
    """Collection name -> id inside a library; None means the whole library."""
    if name is None:
        return None
    row = (
        lib.collections.where((F.col("libraryID") == library_id) & (F.col("collectionName") == name))
        .select("collectionID")
        .limit(1)
        .collect()
    )
    if not row:
        raise ValueError(f'Collection "{name}" not found in library {library_id}')
    return int(row[0][0])


def resolve_fields(lib: Library, names: Sequence[str]) -> dict[str, int]:
    """Field names -> ids; an unknown name raises and lists the available ones."""
    wanted = list(dict.fromkeys(names))
    rows = lib.fieldsCombined.where(F.col("fieldName").isin(wanted)).select("fieldName", "fieldID").collect()
    found = {r[0]: int(r[1]) for r in rows}
    missing = [n for n in wanted if n not in found]
    if missing:
        names_all = [r[0] for r in lib.fieldsCombined.select("fieldName").collect()]
        raise ValueError(f"Field {missing[0]} not found. Available fields are: {', '.join(names_all)}")
    return found


def scoped_items(lib: Library, library: str | None = "", collection: str | None = None) -> DataFrame:
    """Items of one library, restricted to a collection when one is named."""
    lib_id = resolve_library(lib, library)
    items = lib.items.where(F.col("libraryID") == lib_id)
    coll_id = resolve_collection(lib, lib_id, collection)
    if coll_id is not None:
        members = lib.collectionItems.where(F.col("collectionID") == coll_id).select("itemID")
        items = items.join(members, "itemID", "left_semi")
    return items


def field_values(lib: Library, field_ids: Sequence[int]) -> DataFrame:
    """(itemID, fieldID, value) for the given fields."""
    data = lib.itemData.where(F.col("fieldID").isin(list(field_ids)))
    return data.join(lib.itemDataValues, "valueID").select("itemID", "fieldID", "value")


def fetch_item_field(
    lib: Library, field: str, library: str | None = "", collection: str | None = None, key_col: str = "zoteroID"
) -> DataFrame:
    """One field of every item in scope: ``(zoteroID, <field>)``."""
    fid = resolve_fields(lib, [field])[field]
    items = scoped_items(lib, library, collection).select("itemID", F.col("key").alias(key_col))
    vals = field_values(lib, [fid])
    return items.join(vals, "itemID").select(key_col, F.col("value").alias(field))


def fetch_item_fields(
    lib: Library,
    fields_: Sequence[str],
    library: str | None = "",
    collection: str | None = None,
    key_col: str = "zoteroID",
) -> DataFrame:
    """Several fields side by side, NULL where an item lacks one (a full outer union of keys).

    One scan of itemData for all fields and one pivot keyed by item, instead of
    one query per field joined on the key.  ``year`` reads ``date`` and keeps
    its first four digits; ``abstract`` and ``doi`` are aliases.
    """
    stored = {f: ("date" if f == "year" else FIELD_ALIASES.get(f, f)) for f in fields_}
    ids = resolve_fields(lib, list(stored.values()))
    id_to_name = F.create_map(*[x for name, fid in ids.items() for x in (F.lit(fid), F.lit(name))])
    items = scoped_items(lib, library, collection).select("itemID", F.col("key").alias(key_col))
    vals = field_values(lib, list(ids.values())).withColumn("fieldName", F.element_at(id_to_name, F.col("fieldID")))
    # grouped by the item's id the pivot reuses the join's partitioning; a field has one value per item
    wide = items.join(vals, "itemID").groupBy("itemID", key_col).pivot("fieldName", list(ids.keys())).agg(F.max("value"))
    out = [F.col(key_col)]
    for f, src in stored.items():
        c = F.col(f"`{src}`")
        out.append((year_anywhere(c) if f == "year" else c).alias(f))
    return wide.select(*out)


def content_type_short(mime: Column) -> Column:
    """``application/pdf`` -> pdf, ``text/html`` -> html, anything else NULL."""
    out = F.lit(None).cast("string")
    for mime_type, short in CONTENT_TYPES.items():
        out = F.when(mime == mime_type, F.lit(short)).otherwise(out)
    return out


def storage_path(root: str, storage_key: Column, path: Column) -> Column:
    """``<root>/storage/<attachment key>/<path without its 8-char prefix>``; NULL path stays NULL."""
    return F.when(
        path.isNotNull(),
        F.concat(F.lit(root.rstrip("/") + "/storage/"), storage_key, F.lit("/"), F.substr(path, F.lit(len(STORAGE_PREFIX) + 1))),
    )


def flag_duplicates(df: DataFrame, keys: Sequence[str], out_col: str = "is_duplicated") -> DataFrame:
    """True on every row whose key occurs more than once (keep none).

    Counted with a map-side-combined aggregate joined back on the key, so a
    hot key is counted by all map tasks in parallel.
    """
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias(out_col))
    return df.join(counts, list(keys), "left")


def prefer_content(
    df: DataFrame, prefer: str | None, key: str = "zoteroID", mime_col: str = "content_type", strict: bool = False
) -> DataFrame:
    """Among items with several attachments keep the preferred type.

    ``strict=False`` (documented behaviour): drop the other type only for items
    that have both a PDF and an HTML attachment.  ``strict=True`` (what the code
    path did): drop the other type for every item with more than one attachment,
    so an item with two HTML files and no PDF disappears.
    """
    if prefer is None:
        return df
    if prefer not in ("pdf", "html"):
        raise ValueError("prefer must be 'pdf', 'html' or None")
    drop_mime = HTML_MIME if prefer == "pdf" else PDF_MIME
    one_item = Window.partitionBy(key)
    flagged = df.withColumns(
        {
            "_n": F.count(F.lit(1)).over(one_item),
            "_pdf": F.max((F.col(mime_col) == PDF_MIME).cast("int")).over(one_item),
            "_html": F.max((F.col(mime_col) == HTML_MIME).cast("int")).over(one_item),
        }
    )
    several = (F.col("_n") > 1) if strict else ((F.col("_pdf") == 1) & (F.col("_html") == 1))
    drop = several & F.coalesce(F.col(mime_col) == drop_mime, F.lit(False))
    return flagged.where(~drop).drop("_n", "_pdf", "_html")


def existing_paths(df: DataFrame, listing: DataFrame, path_col: str = "path") -> DataFrame:
    """Drop NULL paths and keep those present in a file listing (``path`` column)."""
    present = listing.select(F.col("path").alias(path_col))
    return df.where(F.col(path_col).isNotNull()).join(present, path_col, "left_semi")


def list_files(spark, root: str) -> DataFrame:
    """Paths of the files below ``root`` (contents are not read)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select(F.regexp_replace("path", "^file:", "").alias("path"))


def list_local_path(
    lib: Library,
    root: str,
    prefer: str | None = None,
    check_exists: bool = False,
    listing: DataFrame | None = None,
    library: str | None = "",
    collection: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Attachments of the items in scope with title, DOI, short content type and storage path.

    Items lacking a title or a DOI are not listed.  ``check_exists`` applies
    before ``prefer``; it needs a ``listing`` (see ``list_files``).
    """
    ids = resolve_fields(lib, ["title", "DOI"])
    items = scoped_items(lib, library, collection).select("itemID", F.col("key").alias("zoteroID"))
    def value_of(name: str) -> Column:
        return F.max(F.when(F.col("fieldID") == ids[name], F.col("value")))

    # title and DOI in one pass; attachments with their storage key and path, then one join per item
    named = field_values(lib, [ids["title"], ids["DOI"]]).groupBy("itemID").agg(
        value_of("title").alias("title"), value_of("DOI").alias("doi")
    )
    att = lib.itemAttachments.select(
        F.col("parentItemID").alias("_parent"), "itemID", F.col("contentType").alias("content_type"), "path"
    ).join(lib.items.select("itemID", F.col("key").alias("storageID")), "itemID")
    att = att.select(
        F.col("_parent").alias("itemID"), "content_type", storage_path(root, F.col("storageID"), F.col("path")).alias("path")
    )
    if check_exists:
        if listing is None:
            raise ValueError("check_exists needs a file listing")
        att = existing_paths(att, listing)
    # an item is kept or dropped with all its attachments, so the preferred type can be chosen before the joins
    att = prefer_content(att, prefer, key="itemID", strict=strict)
    df = items.join(named.where("title IS NOT NULL AND doi IS NOT NULL"), "itemID").join(att, "itemID")
    return df.select("zoteroID", "title", "doi", content_type_short(F.col("content_type")).alias("content_type"), "path")


def has_doi(lib: Library, dois: DataFrame, doi_col: str = "doi", field: str | None = None) -> DataFrame:
    """Flag each DOI that equals some stored value (any field unless ``field`` is given).

    Compared by SHA-256, so that long values (abstracts) never leave the scan.
    """
    values = lib.itemDataValues
    if field is not None:
        fid = resolve_fields(lib, [field])[field]
        values = values.join(lib.itemData.where(F.col("fieldID") == fid).select("valueID"), "valueID", "left_semi")
    keys = dois.select(doi_col).where(F.col(doi_col).isNotNull()).distinct()
    keys = keys.withColumn("_sha", F.sha2(doi_col, 256))
    hits = values.select(F.sha2("value", 256).alias("_sha")).distinct().withColumn("in_library", F.lit(True))
    return keys.join(hits, "_sha", "left").select(doi_col, F.coalesce("in_library", F.lit(False)).alias("in_library"))


def has_local(lib: Library, dois: DataFrame, doi_col: str = "doi") -> DataFrame:
    """Content type of an attachment of the item holding each DOI (NULL if none).

    When several attachments exist, the smallest MIME type is reported.
    """
    fid = resolve_fields(lib, ["DOI"])["DOI"]
    keys = dois.select(doi_col).where(F.col(doi_col).isNotNull()).distinct()
    vals = field_values(lib, [fid]).select("itemID", F.col("value").alias(doi_col)).join(keys, doi_col, "left_semi")
    att = lib.itemAttachments.select(F.col("parentItemID").alias("itemID"), "contentType")
    # collect_set is bounded by the few distinct content types and hash-aggregates
    local = vals.join(att, "itemID").groupBy(doi_col).agg(F.array_min(F.collect_set("contentType")).alias("content_type"))
    return keys.join(local, doi_col, "left")
