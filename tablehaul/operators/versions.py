"""Versions of a table's files: numbered notes that are only ever created, never changed.

A version is the list of folders that make up the table. Writers complete new
folders first and then create the note with the next number. Only one writer can
create it; the others begin again from the newest version, so no write is lost.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tablehaul.functions.names import quoted

NOTES = "_versions"
#: Table property that holds the folder of a table's versions.
ROOT = "versions.root"
#: How often a writer begins again after another one was faster.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Other writers were faster ``ATTEMPTS`` times in a row."""


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = _path(spark, folder)
    _system(spark, path).delete(path, True)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    notes = _path(spark, root, NOTES)
    system = _system(spark, notes)
    if not system.exists(notes):
        return []
    names = [status.getPath().getName() for status in system.listStatus(notes)]
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"[0-9]{12}\.json", n))


def _read(spark: SparkSession, root: str, number: int) -> list[str]:
    note = _path(spark, root, NOTES, f"{number:012}.json")
    stream = _system(spark, note).open(note)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def newest(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    """Number and folders of the newest version; (0, []) before the first."""
    numbers = _numbers(spark, root)
    return (numbers[-1], _read(spark, root, numbers[-1])) if numbers else (0, [])


def claim(spark: SparkSession, root: str, number: int, folders: list[str]) -> bool:
    """Create version ``number``; False if it is there already.

    The note is complete before it gets its name, by a rename that does not
    overwrite. HDFS does that as one step; a local folder, as in tests, in two.
    """
    own = _path(spark, root, NOTES, f".{uuid.uuid4().hex}.json")
    note = _path(spark, root, NOTES, f"{number:012}.json")
    system = _system(spark, own)
    out = system.create(own, False)
    try:
        out.write(json.dumps(folders).encode())
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(system.makeQualified(own), system.makeQualified(note), no_options)
    except Py4JJavaError as error:
        system.delete(own, False)
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def add_version(spark: SparkSession, root: str, change: Callable[[list[str]], list[str]]) -> list[str]:
    """Create the next version as ``change`` of the newest one's folders, again where another writer was faster."""
    for _ in range(ATTEMPTS):
        number, folders = newest(spark, root)
        wanted = change(folders)
        if claim(spark, root, number + 1, wanted):
            return wanted
    raise Conflict(f"{root}: {ATTEMPTS} attempts")


# --- catalog tables -------------------------------------------------------


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def create_table(spark: SparkSession, table: str, schema, location: str, root: str | None = None) -> None:
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    known = f" TBLPROPERTIES ('{ROOT}' = '{root}')" if root else ""
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet LOCATION '{location}'{known}")


def root_of(spark: SparkSession, table: str, root: str) -> str:
    """The folder of a table's versions: the one it was made with, else ``root``."""
    if table_exists(spark, table):
        given = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
        return given.get(ROOT, root).rstrip("/")
    return root.rstrip("/")


def current(spark: SparkSession, table: str, root: str) -> tuple[int, DataFrame | None]:
    """Number and rows of the newest version; of a table without versions its rows, None if there is no table."""
    number, folders = newest(spark, root)
    if folders:
        return number, spark.read.parquet(*folders)
    return number, spark.table(table) if table_exists(spark, table) else None


def _kinds(schema) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def open_table(spark: SparkSession, table: str, root: str) -> str:
    """Point the catalog to the newest version, whatever it says now; returns the folder.

    Mends a table whose writer stopped between its commit and here: the files are
    what counts. New columns are added; a table with other columns is defined anew.
    """
    while True:
        number, folders = newest(spark, root)
        schema = spark.read.parquet(*folders).schema
        try:
            if table_exists(spark, table):
                old, new = _kinds(spark.table(table).schema), _kinds(schema)
                if old != new[: len(old)]:
                    spark.sql(f"DROP TABLE {table}")
                elif len(new) > len(old):
                    added = ", ".join(f"{quoted(n)} {k}" for n, k in new[len(old) :])
                    spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({added})")
            if table_exists(spark, table):
                spark.sql(f"ALTER TABLE {table} SET LOCATION '{folders[0]}'")
                spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{ROOT}' = '{root}')")
            else:
                create_table(spark, table, schema, folders[0], root)
        except AnalysisException as error:  # another writer was here at the same time
            if error.getCondition() not in ("TABLE_OR_VIEW_ALREADY_EXISTS", "TABLE_OR_VIEW_NOT_FOUND"):
                raise
            continue
        spark.catalog.refreshTable(table)
        if newest(spark, root)[0] == number:
            return folders[0]


def commit(spark: SparkSession, table: str, root: str, build: Callable[[DataFrame | None], DataFrame], again: bool = True) -> str:
    """Write ``build`` of the newest rows as the next version and point the table to it; returns its folder.

    If another writer creates that version first, ``build`` runs again on the rows
    that writer left; with ``again=False`` the rows don't depend on the old ones,
    and what is written is only given the next number. Readers see one version or the
    other; a failed write changes nothing.
    """
    root = root_of(spark, table, root)
    folder = None
    for _ in range(ATTEMPTS):
        number, rows = current(spark, table, root)
        if folder is None or again:
            folder = f"{root}/v-{uuid.uuid4().hex}"
            build(rows).write.parquet(folder)
        if claim(spark, root, number + 1, [folder]):
            return open_table(spark, table, root)
    raise Conflict(f"{table}: {ATTEMPTS} attempts")


def retire_versions(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete the notes and folders of all but the last ``keep`` versions; returns how many folders went.

    Only folders that a note names go, so those of a writer at work stay. Readers of
    a retired version fail, so keep as many as readers may still be on.
    """
    numbers = _numbers(spark, root)
    old, live = numbers[: -max(1, keep)], set()
    for number in numbers[-max(1, keep) :]:
        live |= set(_read(spark, root, number))
    gone = set()
    for number in old:
        gone |= set(_read(spark, root, number)) - live
    for folder in gone:
        delete_folder(spark, folder)
    for number in old:
        note = _path(spark, root, NOTES, f"{number:012}.json")
        _system(spark, note).delete(note, False)
    return len(gone)
