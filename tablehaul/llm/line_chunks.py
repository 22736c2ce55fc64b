"""Line dedup by content-defined chunks of lines, and by passages of whole lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablehaul.llm.columns import WHITE, let, running_sums, whole
from tablehaul.llm.scratch import discard
from tablehaul.operators.skew import join_per_key
from tablehaul.session import scratch_path

#: A boundary follows a line when the rolling hash of it and the line before is 0 modulo this: two lines a chunk on average.
DIVISOR = 2
#: A line of so many words is a chunk of its own.
LONG_LINE = 40
#: A passage has more words than this.
PASSAGE = 50


def marked(text: Column) -> Column:
    """The lines of a text as array<struct<n, h, g>>: its words and two hashes of its bytes."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(F.size(F.array_remove(F.split(x, WHITE, -1), "")).alias("n"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g")),
    )


def _rolled(m: Column, i: Column) -> Column:
    """A cyclic polynomial over the hashes of two lines: each line turns the hash by one bit and puts its own on top."""
    before = F.coalesce(F.get(m, i - 1)["h"], F.lit(0).cast("bigint"))
    return F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63)).bitwiseXOR(F.get(m, i)["h"])


def chunk_spans(m: Column, divisor: int = DIVISOR, long_line: int = LONG_LINE) -> Column:
    """The chunks of ``marked`` lines as array<struct<first:int,last:int>>.

    A boundary follows a line whose rolling hash is 0 modulo ``divisor``. It depends
    on two neighbouring lines only, so lines put in or taken out shift nothing beyond
    the next boundary. A line of ``long_line`` words is a chunk of its own.
    """
    long = lambda i: F.coalesce(F.get(m, i)["n"] >= long_line, F.lit(False))
    ends = F.filter(
        F.sequence(F.lit(0), F.size(m) - 1),
        lambda i: (i == F.size(m) - 1) | long(i) | long(i + 1) | (F.pmod(_rolled(m, i), F.lit(divisor)) == 0),
    )
    return let(ends, lambda e: F.transform(e, lambda last, j: F.struct(F.coalesce(F.get(e, j - 1) + 1, F.lit(0)).alias("first"), last.alias("last"))))


def _counts(m: Column, r: Column, long_line: int) -> Column:
    """If a chunk has two lines that aren't blank, or is one long line."""
    full = F.filter(F.slice(m, r["first"] + 1, r["last"] - r["first"] + 1), lambda x: x["n"] > 0)
    return (F.size(full) > 1) | (F.get(m, r["first"])["n"] >= long_line)


def chunks(text: Column, divisor: int = DIVISOR, long_line: int = LONG_LINE) -> Column:
    """The chunks of a text with their texts and if they count; joined by line ends they are the text."""

    def cut(lines: Column) -> Column:
        def one(m: Column) -> Column:
            part = lambda r: F.array_join(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), "\n")
            return F.transform(chunk_spans(m, divisor, long_line), lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), part(r).alias("text"), _counts(m, r, long_line).alias("counts")))

        return let(marked(text), one)

    return let(F.split(text, "\n", -1), cut)


def _keyed(packed: DataFrame) -> DataFrame:
    """Rows under the key of their id and text; equal rows are one document listed twice."""
    return packed.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), F.col("text"))})


def _packed(df: DataFrame, text: str, key: str) -> DataFrame:
    others = [F.col(c) for c in df.columns if c not in (key, text)]
    rest = F.struct(*others) if others else F.lit(0)
    return _keyed(df.select(F.col(key).alias("id"), whole(text).alias("text"), F.col(text).isNull().alias("none"), rest.alias("rest")))


def _per_document(packed: DataFrame, per_key: DataFrame) -> DataFrame:
    """``packed`` with the columns that ``per_key`` has for a document (id, k1, k2)."""
    # null ids meet by a marker column, as a join on null keys finds nothing
    some = F.coalesce(F.xxhash64("id"), F.lit(0))
    left = packed.withColumns({"idh": some, "no_id": F.col("id").isNull()})
    right = per_key.withColumns({"idh": some, "no_id": F.col("id").isNull()}).drop("id")
    return join_per_key(left, right, ["idh", "no_id", "k1", "k2"]).drop("idh", "no_id")


def windows(m: Column, most: int = PASSAGE) -> Column:
    """Runs of ``marked`` lines of just over ``most`` words, as array<struct<first:int,last:int>>.

    For each line that isn't blank, the shortest run of over ``most`` words that
    begins with it and the shortest that ends with it. Every line of a passage of
    over ``most`` words is in a window inside the passage, so two copies of it
    share windows that cover them, whatever lines stand around.
    """
    full = F.filter(F.transform(m, lambda x, i: F.struct(i.cast("int").alias("at"), x["n"].cast("bigint").alias("n"))), lambda x: x["n"] > 0)

    def runs(at: Column, before: Column) -> Column:
        # before: words before each full line, and of all; a window has most + 1 full lines at most
        def ahead(i: Column) -> Column:
            return i + F.size(F.filter(F.slice(before, i + 2, F.lit(most + 1)), lambda p: p - F.get(before, i) <= most))

        def back(i: Column) -> Column:
            start = F.greatest(i - most, F.lit(0))
            return i - F.size(F.filter(F.slice(before, start + 1, i - start + 1), lambda p: F.get(before, i + 1) - p <= most))

        run = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
        both = F.concat(F.transform(at, lambda a, i: run(a, F.get(at, ahead(i)))), F.transform(at, lambda a, i: run(F.when(back(i) >= 0, F.get(at, back(i))), a)))
        return F.filter(both, lambda r: r["first"].isNotNull() & r["last"].isNotNull())

    def summed(f: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("bigint")), running_sums(F.transform(f, lambda x: x["n"])))
        return let(before, lambda b: runs(F.transform(f, lambda x: x["at"]), b))

    return let(full, summed)


def _first(p: Column) -> Column:
    return F.shiftright(p, 32).cast("int")


def _last(p: Column) -> Column:
    return p.bitwiseAND(F.lit(2**31 - 1)).cast("int")


def units(text: Column, divisor: int = DIVISOR, long_line: int = LONG_LINE, most: int = PASSAGE) -> Column:
    """The distinct runs of lines that are compared, as array<struct<pos, h1, h2>>: chunks that count, and windows.

    ``pos`` is first line * 2^32 + last line; the hashes are made of the hashes of
    the lines, so that no line is hashed once for each run it is in.
    """
    code = lambda r: F.shiftleft(r["first"].cast("bigint"), 32) + r["last"]

    def hashed(m: Column) -> Column:
        counted = F.filter(chunk_spans(m, divisor, long_line), lambda r: _counts(m, r, long_line))
        # as numbers, of which array_distinct has a hash set
        codes = F.array_distinct(F.transform(F.concat(counted, windows(m, most)), code))
        part = lambda of, p: F.xxhash64(F.slice(of, _first(p) + 1, _last(p) - _first(p) + 1))
        return let(
            F.transform(m, lambda x: x["h"]),
            lambda h: let(F.transform(m, lambda x: x["g"]), lambda g: F.transform(codes, lambda p: F.struct(p.alias("pos"), part(h, p).alias("h1"), part(g, p).alias("h2")))),
        )

    return let(marked(text), hashed)


PLACE = ("id", "k1", "k2", "pos")


def repeated_units(packed: DataFrame, root: str, divisor: int, long_line: int, most: int) -> DataFrame:
    """(id, k1, k2, units): the runs of lines of each document whose hashes occur more than once.

    The runs of all texts are worked out once and written; counting and finding them
    read 40 bytes a run. A passage in a third of all rows is one row a task when it is
    counted, and its places are found by a join that splits hot keys.
    """
    spark = packed.sparkSession
    parts = packed.select("id", "k1", "k2", F.explode(units(F.col("text"), divisor, long_line, most)).alias("u"))
    parts.select("id", "k1", "k2", "u.*").write.parquet(f"{root}/units")
    rows = spark.read.parquet(f"{root}/units")
    often = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hits = join_per_key(rows, often, ["h1", "h2"], "inner")
    return hits.groupBy("id", "k1", "k2").agg(F.collect_list(F.struct("pos", "h1", "h2")).alias("units"))


def first_places(found: DataFrame) -> DataFrame:
    """(id, k1, k2, stay): of the documents' ``units``, those that are the first place of their bytes.

    Runs are grouped by their hashes and their text, which compares the bytes. Places
    are ordered by id (null first), key and position. The partial aggregation leaves
    one row per run and task.
    """

    def runs(lines: Column) -> Column:
        text = lambda u: F.array_join(F.slice(lines, _first(u["pos"]) + 1, _last(u["pos"]) - _first(u["pos"]) + 1), "\n")
        return F.transform("units", lambda u: F.struct(u["pos"].alias("pos"), u["h1"].alias("h1"), u["h2"].alias("h2"), text(u).alias("run")))

    rows = found.select("id", "k1", "k2", F.explode(let(F.split("text", "\n", -1), runs)).alias("u")).select("id", "k1", "k2", "u.*")
    first = rows.groupBy("h1", "h2", "run").agg(F.min(F.struct(*PLACE)).alias("first"))
    return first.select("first.*").groupBy("id", "k1", "k2").agg(F.collect_set("pos").alias("stay"))


def _merged(gone: Column) -> Column:
    """Runs (numbers of ``units``) as disjoint runs in order: array<struct<first:int,last:int>>."""
    runs = F.transform(
        F.array_sort(gone), lambda p: F.struct(_first(p).alias("first"), _last(p).alias("last"))
    )
    kind = "struct<done:array<struct<first:int,last:int>>,now:struct<first:int,last:int>>"
    none = F.struct(F.array().alias("done"), F.lit(None).alias("now")).cast(kind)

    def step(s: Column, r: Column) -> Column:
        now, done = s["now"], s["done"]
        joins = r["first"] <= now["last"] + 1
        longer = F.struct(now["first"].alias("first"), F.greatest(now["last"], r["last"]).alias("last"))
        ended = F.when(now.isNull() | joins, done).otherwise(F.concat(done, F.array(now)))
        return F.struct(ended.alias("done"), F.when(joins, longer).otherwise(r).alias("now")).cast(kind)

    return F.aggregate(runs, none, step, lambda s: F.concat(s["done"], F.array(s["now"])))


def dedup_passages(
    df: DataFrame, text: str = "text", key: str = "doc_id", divisor: int = DIVISOR, long_line: int = LONG_LINE, most: int = PASSAGE
) -> DataFrame:
    """(id, text, removed, chunks, rest): the text without repeated chunks and passages, lines and runs taken out, the other columns.

    A chunk of lines or a run of whole lines of over ``most`` words that an earlier
    place holds byte for byte goes, also within one document, with the blank lines
    between two runs that go. ``chunks`` counts the runs taken out. A line that goes is
    kept at an earlier place, so no line is lost. A null text stays null, an empty
    one empty; null ids take part; rows equal in id and text get the same result; a
    very long text is one row throughout; an empty table gives no rows.
    """
    spark = df.sparkSession
    root = scratch_path(spark, "line-chunks")
    packed = _packed(df, text, key)
    _per_document(packed, repeated_units(packed, root, divisor, long_line, most)).write.parquet(f"{root}/found")
    discard(spark, f"{root}/units")
    found = spark.read.parquet(f"{root}/found")
    some = found.where("units IS NOT NULL")
    stay = _per_document(some, first_places(some))
    places = F.transform("units", lambda u: u["pos"])
    gone = F.array_except(places, F.coalesce("stay", F.array().cast("array<bigint>")))
    touched = stay.withColumn("gone", F.when(F.size(gone) > 0, gone)).drop("units", "stay")
    none = F.lit(None).cast("array<bigint>").alias("gone")
    joined = touched.unionByName(found.where("units IS NULL").select("*", none).drop("units"))

    def cut(lines: Column) -> Column:
        def left(runs: Column) -> Column:
            def gap(k: Column) -> Column:
                start = F.when(k == 0, F.lit(0)).otherwise(F.get(runs, k - 1)["last"] + 1)
                end = F.when(k == F.size(runs), F.size(lines)).otherwise(F.get(runs, k)["first"])
                lying = F.slice(lines, start + 1, end - start)
                inner = (k > 0) & (k < F.size(runs))
                return F.when(inner & ~F.exists(lying, lambda x: x.rlike(r"[^ \t-\r]")), F.array().cast("array<string>")).otherwise(lying)

            kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), gap))
            return let(kept, lambda x: F.struct(F.array_join(x, "\n").alias("text"), (F.size(lines) - F.size(x)).alias("removed"), F.size(runs).alias("chunks")))

        return let(_merged(F.col("gone")), left)

    changed = F.col("gone").isNotNull()
    done = joined.withColumn("cut", F.when(changed, let(F.split(F.col("text"), "\n", -1), cut)))
    clean = F.when(changed, F.col("cut.text")).when(~F.col("none"), F.col("text"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    return done.select("id", clean.alias("text"), number("cut.removed").cast("long").alias("removed"), number("cut.chunks").alias("chunks"), "rest")


def dedup_rows(documents: DataFrame) -> DataFrame:
    """doc_id, lines and runs of lines taken out, digest and length of what is left."""
    done = dedup_passages(documents.select("doc_id", "text"))
    left = F.coalesce("text", F.lit(""))
    return done.select(
        F.col("id").alias("doc_id"), F.col("removed").alias("n_removed_lines"), F.col("chunks").cast("long").alias("n_removed_chunks"),
        F.length(left).cast("long").alias("n_chars_left"), F.sha2(left, 256).alias("text_sha256"),
    )
