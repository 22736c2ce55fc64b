"""One table's whole way: scan, blank rows, matching, write mode, count of what is stored, run record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tablehaul.operators.merge import skip_existing
from tablehaul.operators.versions import commit, table_exists
from tablehaul.operators.writes import _order_names, prepare, replace_load, truncate_load, upsert_load

MODES = ("append", "truncate", "replace", "upsert", "skip_existing")


def copy_table(src: DataFrame, table: str, root: str, mode: str = "append", keys: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Copy ``src`` into the catalog table and return its run record, one row.

    Rows are counted where they are: those sent while they are written, those of
    the target by reading the stored table afterwards. Folders of new versions go
    below ``root``. A failed write raises and leaves the table as it was.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    if mode in ("upsert", "skip_existing") and not keys:
        raise ValueError(f"{mode} needs key columns")
    spark, seen = src.sparkSession, Observation()
    there = table_exists(spark, table)
    rows = src.observe(seen, F.count(F.lit(1)).alias("read"))
    if mode == "replace" or not there:
        sent = replace_load(rows, table, root)
    elif mode == "truncate":
        sent = truncate_load(rows, table, root)
    elif mode == "upsert":
        sent = None
        upsert_load(rows, table, root, keys, order_by)
    else:
        sent = None

        def after(target: DataFrame) -> DataFrame:
            ready = prepare(rows, target.schema, order_by or [], fill=True)
            if mode == "append":
                return target.unionByName(ready.select(*target.columns))
            return skip_existing(target, ready, keys, _order_names(order_by)).select(*target.columns)

        commit(spark, table, root, after)
    stored = spark.table(table).count()
    read = seen.get["read"] if sent is None else sent
    return spark.createDataFrame(
        [(table, mode, "success", read, stored, max(read - stored, 0))],
        "table_name string, mode string, status string, source_row_count bigint, target_row_count bigint, missing_row_count bigint",
    )
