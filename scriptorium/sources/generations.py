"""Folders of data that grow by whole generations.

A job fills a new sub-folder ``generation=<number>`` with Spark's own writer and
then puts a small marker file into it.  Readers look at marked folders only, so
a job that dies before or while it writes changes nothing, and nothing is ever
deleted to make room for what replaces it.  The marker holds a note (JSON) on
what the generation is; a generation whose note ``covers`` others stands in for
them.

Only names and markers pass through the driver: one entry per generation, not
per file or row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import SparkSession

PREFIX = "generation="
MARK = "_committed"
CLAIM = "_claimed"
NUMBER = re.compile(re.escape(PREFIX) + r"(\d+)$")


class Generation(NamedTuple):
    number: int
    path: str
    note: dict[str, Any]


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for any store the cluster reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def entries(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what stands directly in a folder; empty where there is none."""
    fs, p = _path(spark, path)
    return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)] if is_folder(spark, path) else []


def _numbers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    found = [(NUMBER.match(name), name) for name, folder in entries(spark, root) if folder]
    return sorted((int(m.group(1)), f"{root.rstrip('/')}/{name}") for m, name in found if m)


def _note(spark: SparkSession, path: str) -> dict[str, Any] | None:
    fs, mark = _path(spark, f"{path}/{MARK}")
    if not fs.exists(mark):
        return None
    stream = fs.open(mark)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _mark(spark: SparkSession, path: str, note: dict[str, Any]) -> None:
    fs, unfinished = _path(spark, f"{path}/_{MARK}")
    out = fs.create(unfinished, True)
    out.write(json.dumps(note).encode())
    out.close()
    _, mark = _path(spark, f"{path}/{MARK}")
    if not fs.rename(unfinished, mark):
        raise OSError(f"could not commit {path}")


def committed(spark: SparkSession, root: str) -> list[Generation]:
    """All marked generations by number, those that others cover included."""
    found = [(n, path, _note(spark, path)) for n, path in _numbers(spark, root)]
    return [Generation(n, path, note) for n, path, note in found if note is not None]


def live(spark: SparkSession, root: str) -> list[Generation]:
    """The marked generations that no other one covers."""
    found = committed(spark, root)
    covered = {n for g in found for n in g.note.get("covers", ())}
    return [g for g in found if g.number not in covered]


def add(
    spark: SparkSession, root: str, save: Callable[[str], None], note: Callable[[str], dict[str, Any]] | dict[str, Any] | None = None
) -> Generation:
    """Let ``save`` write a new generation, then make it visible.

    ``save`` gets a folder that holds nothing but a hidden file (so it appends);
    ``note`` is a dict, or a function of the written folder that gives one.
    """
    number = max((n for n, _ in _numbers(spark, root)), default=0) + 1
    while True:
        path = f"{root.rstrip('/')}/{PREFIX}{number:08d}"
        fs, claim = _path(spark, f"{path}/{CLAIM}")
        if fs.createNewFile(claim):
            break
        number += 1  # another job has just taken it
    save(path)
    told = note(path) if callable(note) else dict(note or {})
    _mark(spark, path, told)
    return Generation(number, path, told)


def drop_covered(spark: SparkSession, root: str) -> None:
    """Delete the generations that committed ones cover (call it when nothing reads them any more)."""
    found = committed(spark, root)
    covered = {n for g in found for n in g.note.get("covers", ())}
    for g in found:
        if g.number in covered:
            fs, p = _path(spark, g.path)
            fs.delete(p, True)
