"""Staged CSV files: headered with a null mark, or headerless with \\N."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tablehaul.functions.encode import STYLES, cell_value
from tablehaul.functions.names import quoted
from tablehaul.operators import versions
from tablehaul.operators.columns import encode_cells
from tablehaul.session import scratch_path

# The same quoting for writing and reading; cells may hold line ends and blanks.
_FORMAT = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
#: Bytes of text a staged file should have at most, and the share of rows that are measured for it.
FILE_BYTES, MEASURED = 64 << 20, 0.01


def rows_for(encoded: DataFrame, file_bytes: int = FILE_BYTES, share: float = MEASURED) -> int:
    """How many rows of encoded cells make a file of about ``file_bytes``, by the mean of a sample; of all rows where the sample has too few."""
    cell = lambda c: F.octet_length(F.coalesce(F.col(quoted(c)), F.lit(""))) + F.lit(3)
    size = sum((cell(c) for c in encoded.columns), F.lit(1)).cast("long").alias("bytes")
    sizes = encoded.select(size)
    found = sizes.sample(share, seed=1).agg(F.avg("bytes"), F.count("*")).first()
    if found[1] < 1000:
        found = sizes.agg(F.avg("bytes"), F.count("*")).first()
    return max(1, int(file_bytes / found[0])) if found[1] else 1


def stage_csv(df: DataFrame, path: str, style: str = "sentinel", rows_per_file: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write ``df`` as staged text.

    A quoted cell may hold line ends, so a file is read by one task; files have about
    ``file_bytes`` at most, whatever the size of the cells. That takes a look at the
    source's rows first, which ``rows_per_file`` spares.
    """
    encoded = encode_cells(df, style)
    rows = rows_per_file or rows_for(encoded, file_bytes)
    writer = encoded.write.mode("overwrite").options(**_FORMAT)
    writer.option("maxRecordsPerFile", rows).csv(path, header=STYLES[style].header, lineSep="\n")


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether a data file is at or below ``path``; looks no further than the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return False
    files = system.listFiles(folder, True)
    while files.hasNext():
        if files.next().getPath().getName()[:1] not in ("_", "."):
            return True
    return False


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str, style: str = "sentinel") -> DataFrame:
    """Read a staged file or, recursively, a folder of them; columns go by position.

    The null mark becomes null, an empty cell the empty string. A cell that does
    not fit its type, or a row of the wrong width, fails the load.
    """
    kinds = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(kinds.fields))])
    raw = (
        spark.read.schema(text)
        .options(**_FORMAT)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .csv(path, header=STYLES[style].header)
    )
    if not _has_files(spark, path):
        raise FileNotFoundError(f"no staged files in {path}")
    return raw.select(
        *[cell_value(F.col(f"c{i}"), f.dataType, STYLES[style], f.name).alias(f.name) for i, f in enumerate(kinds.fields)]
    )


def bulk_extract(df: DataFrame, path: str, output_partitions: int | None = None, count_rows: bool = True) -> dict:
    """Scan to headered CSV; rows are counted while they are scanned.

    One task writes a file. With ``output_partitions`` the scan keeps all its tasks:
    it deals its rows evenly to so many folders of compressed columns below the
    shared scratch folder, and a file's task reads its folder.
    """
    spark = df.sparkSession
    counted = Observation()
    out = df.observe(counted, F.count(F.lit(1)).alias("row_count")) if count_rows else df
    flat = [
        F.to_json(quoted(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        else F.col(quoted(f.name))
        for f in df.schema.fields
    ]
    out = out.select(*flat)
    staged = scratch_path(spark, "extract-stage")
    if output_partitions:
        out = _dealt(out, staged, max(1, output_partitions))
    out.write.mode("overwrite").options(**_FORMAT).csv(path, header=True)
    if output_partitions:
        versions.delete_folder(spark, staged)
    return {
        "status": "success",
        "output_dir": path,
        "row_count": counted.get["row_count"] if count_rows else None,
        "num_partitions": output_partitions,
    }


def _dealt(df: DataFrame, staged: str, files: int) -> DataFrame:
    """``df`` from a copy in ``staged``, in ``files`` partitions of nearly as many rows each; fewer only where rows are."""
    spark, names = df.sparkSession, df.columns
    # places as names, as folders hold the number of the file beside them
    turn = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(files)).cast("int")
    copy = df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("file", turn)
    copy.write.partitionBy("file").option("compression", "zstd").parquet(staged)
    rows = spark.read.schema(copy.schema).parquet(staged)
    # each folder has a scan and so a partition of its own, however small; their scans have equally many
    folders = [rows.where(F.col("file") == i).drop("file") for i in range(files)]
    return reduce(DataFrame.unionAll, folders).coalesce(files).toDF(*names)
