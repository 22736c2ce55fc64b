"""Write modes: append, truncate, replace, merge and mirror."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tablehaul.functions.names import quoted
from tablehaul.operators import versions
from tablehaul.operators.columns import append_evolving, drop_blank_rows, matched_names
from tablehaul.operators.history import log_rows, mirror_objects, mirrored_parts, newest_records, run_rows
from tablehaul.operators.merge import new_rows, upsert
from tablehaul.operators.skew import join_per_key
from tablehaul.operators.versions import create_table, delete_folder, table_exists
from tablehaul.session import scratch_path


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def prepare(src: DataFrame, target_schema, order_by: list[str] = (), fill: bool = False) -> DataFrame:
    """What is sent to a target: no blank rows, the shared columns, the target's names and types.

    Columns of ``order_by``, named as in the source, come along as ``_order_0``
    and so on, whether the target has them or not; an unknown one is an error.
    With ``fill`` the target's other columns are there as typed nulls, in its order.
    """
    unknown = [c for c in order_by if c not in src.columns]
    if unknown:
        raise ValueError(f"the source has no column {unknown} to order by; it has {src.columns}")
    kinds = {f.name: f.dataType for f in target_schema.fields}
    pairs = matched_names(src.columns, target_schema.names)
    rows = drop_blank_rows(src)
    values = {t: F.col(quoted(s)).cast(kinds[t]).alias(t) for s, t in pairs}
    if fill:
        values = {n: values.get(n, F.lit(None).cast(kinds[n]).alias(n)) for n in target_schema.names}
    return rows.select(*values.values(), *[F.col(quoted(c)).alias(f"_order_{i}") for i, c in enumerate(order_by)])


def _order_names(order_by: list[str] | None) -> list[str] | None:
    return [f"_order_{i}" for i in range(len(order_by))] if order_by else None


def append_load(src: DataFrame, path: str) -> int:
    """Insert into the table at ``path``; returns the rows sent. Columns the source lacks are null."""
    spark = src.sparkSession
    counted, seen = _counted(prepare(src, spark.read.parquet(path).schema, fill=True))
    counted.write.mode("append").parquet(path)
    return seen.get["n"]


def truncate_load(src: DataFrame, table: str, location: str) -> int:
    """Empty the table, keep its definition, insert. A table that is not there is created."""
    spark = src.sparkSession
    if not table_exists(spark, table):
        create_table(spark, table, src.schema, location)
    counted, seen = _counted(prepare(src, spark.table(table).schema, fill=True))
    counted.write.insertInto(table, overwrite=True)
    return seen.get["n"]


def replace_load(src: DataFrame, table: str, location: str) -> int:
    """Give the table the source's columns and rows, whatever it had before.

    A new version below ``location``: its files are complete before it counts, so the
    source may read the table itself and a failed write changes nothing. A table
    keeps the folder of versions it was made with.
    """
    counted, seen = _counted(drop_blank_rows(src))
    versions.commit(src.sparkSession, table, location, lambda _: counted, again=False)
    return seen.get["n"]


def publish(df: DataFrame, table: str, root: str) -> str:
    """Make ``df`` the table's next version below ``root``; returns its folder.

    The plan may read the table itself: the old files stay until the new ones are
    complete, and readers see one version or the other. Whatever other writers did
    meanwhile is replaced; to keep it, use :func:`versions.commit`.
    """
    return versions.commit(df.sparkSession, table, root, lambda _: df, again=False)


def upsert_load(src: DataFrame, table: str, root: str, keys: list[str], order_by: list[str] | None = None) -> str:
    """Merge into a table by key; built-in file formats have no MERGE, so a new version is committed.

    If another writer commits first, the merge is planned again on its rows, so
    neither loses any.
    """

    def merged(tgt: DataFrame) -> DataFrame:
        return upsert(tgt, prepare(src, tgt.schema, order_by or []), keys, _order_names(order_by))

    return versions.commit(src.sparkSession, table, root, merged)


def skip_existing_load(src: DataFrame, path: str, keys: list[str], order_by: list[str] | None = None) -> int:
    """Append the rows whose key the table at ``path`` lacks; nothing else is written."""
    tgt = src.sparkSession.read.parquet(path)
    ready = prepare(src, tgt.schema, order_by or [], fill=True)
    counted, seen = _counted(new_rows(tgt, ready, keys, _order_names(order_by)).select(*[F.col(quoted(c)) for c in tgt.columns]))
    counted.write.mode("append").parquet(path)
    return seen.get["n"]


def evolve_load(src: DataFrame, table: str, root: str) -> str:
    """Append with new source columns added to the table."""
    return versions.commit(src.sparkSession, table, root, lambda tgt: append_evolving(tgt, drop_blank_rows(src)))


# --- children of runs -----------------------------------------------------

_GENERATION = r"/(g-[0-9a-f]{32})/"


def mirror_children(fresh: DataFrame, runs: DataFrame, path: str) -> None:
    """Delete the children of ``runs`` (run_id) at ``path`` and insert ``fresh``; the first call creates it.

    Nothing stored is read or rewritten: a call adds a generation, a folder with the
    new children and one with the runs it speaks for, those of ``runs`` and of
    ``fresh``. Readers take each run's children from the last generation that names it,
    so a run that is named without children has none. A null run_id belongs to no run.
    The generation counts from its version note on; a failed call leaves nothing that counts, and
    calls at the same time come one after the other.
    """
    spark = fresh.sparkSession
    folder = f"{path.rstrip('/')}/g-{uuid.uuid4().hex}"
    fresh.write.parquet(f"{folder}/children")
    _add_generation(spark, path, folder, runs, fresh.schema)


def _add_generation(spark: SparkSession, path: str, folder: str, runs: DataFrame, schema) -> None:
    # the runs of what was written, should ``fresh`` come out differently when computed again
    written = spark.read.schema(schema).parquet(f"{folder}/children").select("run_id")
    runs.select("run_id").unionAll(written).where("run_id IS NOT NULL").distinct().write.parquet(f"{folder}/runs")
    versions.add_version(spark, path.rstrip("/"), lambda folders: [*folders, folder])


def _children_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    place = F.create_map(*[F.lit(x) for i, folder in enumerate(folders) for x in (folder.rsplit("/", 1)[1], i)])
    at = F.element_at(place, F.regexp_extract("_metadata.file_path", _GENERATION, 1)).alias("_at")
    children = spark.read.parquet(*[f"{f}/children" for f in folders]).where("run_id IS NOT NULL")
    if len(folders) == 1:
        return children
    runs = spark.read.parquet(*[f"{f}/runs" for f in folders]).select("run_id", at)
    last = runs.groupBy("run_id").agg(F.max("_at").alias("_at"))
    return join_per_key(children.select("*", at), last, ["run_id", "_at"], "inner").drop("_at")


def read_children(spark: SparkSession, path: str) -> DataFrame:
    """The children of every run, from the last generation that names it: a narrow maximum per run and one join."""
    folders = versions.newest(spark, path.rstrip("/"))[1]
    if not folders:
        raise FileNotFoundError(f"nothing is mirrored at {path}")
    return _children_of(spark, folders)


def compact_children(spark: SparkSession, path: str) -> str:
    """Write the current children as one generation in place of all they came from; returns its folder.

    Generations that are added meanwhile stay behind it and keep their say. The old
    folders stay for readers that began before; ``versions.retire_versions`` deletes them.
    """
    root = path.rstrip("/")
    old = versions.newest(spark, root)[1]
    if not old:
        raise FileNotFoundError(f"nothing is mirrored at {path}")
    folder = f"{root}/g-{uuid.uuid4().hex}"
    _children_of(spark, old).write.parquet(f"{folder}/children")
    spark.read.parquet(f"{folder}/children").select("run_id").distinct().write.parquet(f"{folder}/runs")

    def swapped(now: list[str]) -> list[str]:
        if now[: len(old)] != old:
            raise versions.Conflict(f"{path} was compacted by another writer")
        return [folder, *now[len(old) :]]

    versions.add_version(spark, root, swapped)
    return folder


def mirror_records(records: DataFrame, table: str, root: str, order: str = "seq") -> None:
    """Mirror run records: their runs into the catalog table, their log lines and objects below ``root``.

    Of several records of one run the newest counts, for all three. Objects and
    lines that a run had before are gone. The runs are stored last, so a run that is
    listed has its children. The newest records are worked out once, as a scratch copy
    of what is stored of them, which all three are made from.
    """
    spark = records.sparkSession
    root = root.rstrip("/")
    picked = newest_records(mirrored_parts(records, order), order)
    copy = scratch_path(spark, "newest-records")
    picked.write.parquet(copy)
    newest = spark.read.schema(picked.schema).parquet(copy)
    named = newest.select("run_summary.run_id")
    mirror_children(log_rows(newest), named, f"{root}/logs")
    mirror_children(mirror_objects(newest), named, f"{root}/objects")
    parents = run_rows(newest)
    if table_exists(spark, table) or versions.newest(spark, f"{root}/runs")[1]:
        upsert_load(parents, table, f"{root}/runs", ["run_id"])
    else:
        publish(parents, table, f"{root}/runs")
    delete_folder(spark, copy)
