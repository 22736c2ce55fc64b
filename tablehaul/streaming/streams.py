"""Streams: live log, change feed and continuous upsert."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tablehaul.functions.messages import log_level, log_stamp, log_text, log_tone
from tablehaul.operators.merge import one_per_key, unkeyed, keyed, upsert
from tablehaul.operators.versions import commit

LIVE_EVENT = "type string, message string, run_id string, seq bigint"


BROKEN = "_broken"


def live_log(spark: SparkSession, path: str, schema: str = LIVE_EVENT) -> DataFrame:
    """Log events that arrive as JSON lines in a folder; ``_broken`` has the text of a line that is none."""
    reader = spark.readStream.schema(f"{schema}, {BROKEN} string")
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)


def broken_lines(events: DataFrame) -> DataFrame:
    """The lines of a live log that are no events, with what could be read of them, for a sink of their own."""
    return events.filter(F.col(BROKEN).isNotNull()).withColumnRenamed(BROKEN, "line")


def describe_log(events: DataFrame) -> DataFrame:
    """Level, tone, time and text of log events; the same on a stream and on a batch. Broken lines are no events."""
    message = F.col("message")
    whole = events.filter(F.col(BROKEN).isNull()) if BROKEN in events.columns else events
    return whole.filter(F.col("type") == "log").select(
        *[c for c in events.columns if c not in ("type", "message", BROKEN)],
        log_level(message).alias("level"),
        log_tone(message).alias("tone"),
        log_stamp(message).alias("logged_at"),
        log_text(message).alias("text"),
    )


#: Where each line of a live log goes.
OUTPUTS = ("log", "other", "broken")


def start_log(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Split a live log: each line goes to one of ``log``, ``other`` (events of other types) and ``broken`` below ``path``.

    All three are written from the same micro-batch, into folders of that batch
    which a replay overwrites; :func:`read_log` reads one of them.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read once; lost blocks are read again from the same files
        is_broken = F.col(BROKEN).isNotNull()
        parts = {
            "log": describe_log(batch),
            "other": batch.filter(~is_broken & ~F.col("type").eqNullSafe(F.lit("log"))).drop(BROKEN),
            "broken": broken_lines(batch),
        }
        for name in OUTPUTS:
            parts[name].write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        batch.unpersist()

    writer = events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_log(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One output of :func:`start_log`, with the number of the batch each line came in."""
    if name not in OUTPUTS:
        raise ValueError(f"unknown output {name!r}; one of {OUTPUTS}")
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def table_changes(spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None) -> DataFrame:
    """New rows of a table folder as they arrive."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def change_events(rows: DataFrame, key: str, event: str, processed_at: str) -> DataFrame:
    """(key, trigger_event, processed_at) per changed row; the time is one of the row."""
    return rows.select(F.col(key), F.lit(event).alias("trigger_event"), F.col(processed_at).alias("processed_at"))


def start_sink(df: DataFrame, path: str, checkpoint: str, every: str | None = None, fmt: str = "parquet") -> StreamingQuery:
    """Append a stream to files; without ``every`` what is there is processed, then the query ends."""
    writer = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", path).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_upsert(feed: DataFrame, path: str, checkpoint: str, keys: list[str], order_by: list[str], every: str | None = None) -> StreamingQuery:
    """Continuous upsert, first half: each micro-batch is cut to its last row per key and kept.

    The target is not rewritten per batch. A batch writes only its own ``batch_id``
    folder and overwrites it when it is replayed, so a retry changes nothing;
    :func:`current_rows` merges on reading and :func:`fold` publishes a version that
    has the batches when wanted.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        last = one_per_key(keyed(batch, keys), keys, order_by).unionByName(unkeyed(batch, keys))
        last.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = feed.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def folded_batch(spark: SparkSession, path: str) -> int:
    """The last batch that a published version has; -1 before the first."""
    try:
        return spark.read.schema("batch_id bigint").json(f"{path}/_folded").agg(F.max("batch_id")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def current_rows(tgt: DataFrame, path: str, keys: list[str], order_by: list[str]) -> DataFrame:
    """The target with all batches merged in that no published version has, later ones over earlier ones."""
    spark = tgt.sparkSession
    try:
        changes = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as error:  # no batch yet, or all retired
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return tgt
    fresh = changes.filter(F.col("batch_id") > folded_batch(spark, path))
    return upsert(tgt, fresh, keys, ["batch_id", *order_by])


def fold(table: str, root: str, path: str, keys: list[str], order_by: list[str]) -> None:
    """Publish the current rows as a new version of the table, and pass over its batches from then on.

    The batches stay until :func:`retire` deletes them, so a reader that began
    before can finish. A failure before the note is written only means that the
    next reader merges the same batches again, which changes nothing.
    """
    spark = SparkSession.active()
    batches = spark.read.option("basePath", path).parquet(path).agg(F.max("batch_id")).first()[0]
    commit(spark, table, root, lambda rows: current_rows(rows, path, keys, order_by).select(*rows.columns))
    spark.createDataFrame([(batches,)], "batch_id bigint").coalesce(1).write.mode("append").json(f"{path}/_folded")


def retire(spark: SparkSession, path: str) -> int:
    """Delete the folders of batches that a published version has; returns their number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    last, gone = folded_batch(spark, path), 0
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name.split("=")[1]) <= last:
            gone += bool(system.delete(status.getPath(), True))
    return gone
