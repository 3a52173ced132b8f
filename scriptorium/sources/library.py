"""The reference library: eight entity-attribute-value tables.

A desktop reference manager keeps items, their field values and attachments
in a handful of relational tables.  Here they are read as Spark tables
(Parquet or CSV exports, or JDBC) and queried with joins; nothing talks to a
live database.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

# Table names and their columns.
LIBRARY_SCHEMA = {
    "items": "itemID long, key string, libraryID long",
    "itemData": "itemID long, fieldID long, valueID long",
    "itemDataValues": "valueID long, value string",
    "fieldsCombined": "fieldID long, fieldName string",
    "collections": "collectionID long, libraryID long, collectionName string",
    "collectionItems": "collectionID long, itemID long",
    "groups": "libraryID long, name string",
    "itemAttachments": "itemID long, parentItemID long, contentType string, path string",
}


@dataclass(frozen=True)
class Library:
    items: DataFrame
    itemData: DataFrame  # noqa: N815
    itemDataValues: DataFrame  # noqa: N815
    fieldsCombined: DataFrame  # noqa: N815
    collections: DataFrame
    collectionItems: DataFrame  # noqa: N815
    groups: DataFrame
    itemAttachments: DataFrame  # noqa: N815

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def load_library(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> Library:
    """Open an exported library read-only: one table per sub-folder ``path/<table>``."""
    frames = {}
    for name, ddl in LIBRARY_SCHEMA.items():
        reader = spark.read.format(fmt).options(**options)
        if fmt != "parquet":
            reader = reader.schema(ddl)
        frames[name] = reader.load(f"{path.rstrip('/')}/{name}")
    return Library(**frames)


def load_library_jdbc(spark: SparkSession, url: str, **options) -> Library:
    """Open the library tables through JDBC (e.g. a SQLite file with its driver on the classpath)."""
    frames = {
        name: spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()
        for name in LIBRARY_SCHEMA
    }
    return Library(**frames)


def save_library(lib: Library, path: str, mode: str = "errorifexists") -> None:
    for name, df in lib.tables().items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
