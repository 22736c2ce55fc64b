"""Product codes of vectors: integer k-means per part with Drake-Hamerly adaptive bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablehaul.operators.skew import join_per_key
from tablehaul.session import scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components become integers of at most this size, so that all sums are exact in 64 bits.
LIMIT = 1 << 24
#: Closest entries whose bounds a part keeps at first, and at least.
KEEP_FIRST, KEEP_LEAST = 32, 4
#: Share of parts that may need more bounds than are kept after an adaption.
OVER = 0.002
#: Rows of vectors that are worked on at a time.
ROWS = 2048


def whole_numbers(vector: Column) -> Column:
    """floor(1024 * x) of each component, held within ``LIMIT``."""
    bound = float(LIMIT)
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(2 * bound)), F.lit(-2 * bound))), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))


def is_whole(vector: Column) -> Column:
    """A vector that is there and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def part_width(length: int) -> int:
    return -(-length // PARTS)


def integer_rows(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(q, rest) of the kept rows, and the width of a part.

    ``q`` holds the integers, filled up with zeros to the longest vector and to a
    multiple of four.
    """
    kept = df.where(is_whole(F.col(vector)))
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = part_width(longest)
    numbers = whole_numbers(F.col(vector))
    filled = F.concat(numbers, F.array_repeat(F.lit(0), F.lit(PARTS * width) - F.size(vector)))
    return kept.select(filled.alias("q"), F.struct(*[F.col(c) for c in df.columns]).alias("rest")), width


def first_codebooks(rows: DataFrame, key: str, width: int) -> np.ndarray:
    """Entries x parts x width: the vectors of the ``ENTRIES`` least keys, null keys last and ties by their numbers."""
    key_of = F.col("rest")[key]
    least = rows.select(key_of.alias("k"), "q").orderBy(F.col("k").asc_nulls_last(), "q").limit(ENTRIES).collect()
    return np.array([r["q"] for r in least], np.int64).reshape(len(least), PARTS, width).transpose(1, 0, 2).copy()


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integers, parts x entries."""
    most = int(max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, parts.shape[1]) < 1 << 52:  # products of floats are exact so far
        x, c = parts.astype(np.float64), entries.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    out = np.zeros((len(parts), len(entries)), np.int64)
    for j in range(parts.shape[1]):
        out += (parts[:, j, None] - entries[None, :, j]) ** 2
    return out


def squared_of(parts: np.ndarray, entries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each part to one entry."""
    return ((parts - entries[ids]) ** 2).sum(axis=1)


def below(x: np.ndarray) -> np.ndarray:
    """Floats that are certainly no larger than ``x``, in 4 bytes."""
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Bounds:
    """What is kept of n parts: the entry each has, its ``keep`` closest other entries with lower bounds, and one outer bound for all the rest.

    The bounds are those of distances, not of squares, and grow from left to right.
    """

    def __init__(self, code: np.ndarray, ids: np.ndarray, lower: np.ndarray, outer: np.ndarray):
        self.code, self.ids, self.lower, self.outer = code, ids, lower, outer

    @staticmethod
    def of(distances: np.ndarray, keep: int) -> Bounds:
        """From the squared distances to all entries."""
        n, k = distances.shape
        code = distances.argmin(axis=1)  # ties go to the lower index
        others = distances.astype(np.float64)
        others[np.arange(n), code] = -1
        keep = min(keep, k - 1)
        if keep + 1 < k:
            order = np.argpartition(others, keep + 1, axis=1)[:, : keep + 2]
        else:
            order = np.tile(np.arange(k), (n, 1))
        values = np.take_along_axis(others, order, axis=1)
        inner = np.argsort(values, axis=1, kind="stable")
        order, values = np.take_along_axis(order, inner, axis=1), np.sqrt(np.maximum(np.take_along_axis(values, inner, axis=1), 0))
        outer = below(values[:, keep + 1]) if keep + 1 < k else np.full(n, np.inf, np.float32)
        return Bounds(code, order[:, 1 : keep + 1], below(values[:, 1 : keep + 1]), outer)


def reassign(parts: np.ndarray, entries: np.ndarray, moved: np.ndarray, old: Bounds, keep: int) -> tuple[Bounds, np.ndarray]:
    """The bounds after the entries moved by ``moved``, and how many kept entries each part had to look at.

    Lower bounds sink by what their entry moved, the outer bound by the largest move.
    The distance to the part's own entry is computed exactly. Where the bounds say
    that no other entry is as near, nothing else is done; entries whose bound is
    not above are computed in integers; where the outer bound is not above either,
    all entries are, and the part gets new bounds. ``keep`` is the number of bounds
    that are kept on.
    """
    n, k = len(parts), len(entries)
    lower = old.lower.astype(np.float64) - moved[old.ids]
    np.minimum.accumulate(lower[:, ::-1], axis=1, out=lower[:, ::-1])  # again growing from left to right
    outer = old.outer.astype(np.float64) - moved.max(initial=0)
    own = squared_of(parts, entries, old.code)
    reach = np.sqrt(own.astype(np.float64)) * (1 + 1e-9) + 1e-6  # an entry beyond is certainly farther
    looked = (lower <= reach[:, None]).sum(axis=1)
    everything = outer <= reach
    code, ids = old.code.copy(), old.ids.copy()

    some = np.flatnonzero((looked > 0) & ~everything)
    for width in np.unique(looked[some]).tolist():
        at = some[looked[some] == width]
        near = ids[at, :width].astype(np.int64)
        exact = np.stack([squared_of(parts[at], entries, near[:, j]) for j in range(width)], axis=1)
        both, names = np.concatenate([own[at, None], exact], axis=1), np.concatenate([code[at, None], near], axis=1)
        best = np.where(both == both.min(axis=1)[:, None], names, k).min(axis=1)  # ties go to the lower index
        values = np.where(names == best[:, None], -1.0, np.sqrt(both.astype(np.float64)))
        order = np.argsort(values, axis=1, kind="stable")[:, 1:]
        code[at] = best
        ids[at[:, None], np.arange(width)] = np.take_along_axis(names, order, axis=1)
        lower[at[:, None], np.arange(width)] = np.take_along_axis(values, order, axis=1)
        # bounds behind the ones just computed may be smaller than these
        part = lower[at]
        np.minimum.accumulate(part[:, ::-1], axis=1, out=part[:, ::-1])
        lower[at] = part

    # the first bound that is no longer kept joins the outer one
    cut = min(keep, lower.shape[1])
    if cut < lower.shape[1]:
        outer = np.minimum(outer, lower[:, cut])
    new = Bounds(code, ids[:, :cut], below(lower[:, :cut]), below(outer))
    full = np.flatnonzero(everything)
    if len(full):
        fresh = Bounds.of(squared(parts[full], entries), cut)
        new.code[full], new.ids[full], new.lower[full], new.outer[full] = fresh.code, fresh.ids, fresh.lower, fresh.outer
    return new, np.where(everything, k, looked)


STATE = "vector binary, code binary, ids binary, lower binary, outer binary, looked binary, error bigint"


def _packed(numbers: np.ndarray, kind: str) -> pa.Array:
    rows = np.ascontiguousarray(numbers.astype(kind)).reshape(len(numbers), -1)
    size = rows.shape[1] * rows.itemsize
    raw = rows.tobytes()
    return pa.array([raw[i * size : (i + 1) * size] for i in range(len(rows))], pa.binary())


def _unpacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _state(parts: np.ndarray, entries: np.ndarray, per_part: list[Bounds], looked: np.ndarray, rest: pa.Array) -> pa.RecordBatch:
    error = sum(squared_of(parts[:, p], entries[p], per_part[p].code) for p in range(PARTS))
    stacked = lambda name: np.stack([getattr(b, name) for b in per_part], axis=1)
    arrays = [
        _packed(parts, "<i4"), _packed(stacked("code"), "u1"), _packed(stacked("ids"), "u1"), _packed(stacked("lower"), "<f4"), _packed(stacked("outer"), "<f4"),
        _packed(looked, "<u2"), pa.array(error.astype(np.int64)), rest,
    ]
    return pa.RecordBatch.from_arrays(arrays, [*(f.split()[0] for f in STATE.split(", ")), "rest"])


def _state_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(STATE).fields, rows.schema["rest"]])


def first_state(rows: DataFrame, entries: np.ndarray, keep: int) -> DataFrame:
    """Every part with its nearest entry and bounds from the distances to all entries."""
    width = entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                parts = part.column("q").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, PARTS, width)
                per_part = [Bounds.of(squared(parts[:, p], entries[p]), keep) for p in range(PARTS)]
                yield _state(parts, entries, per_part, np.zeros((len(parts), PARTS)), part.column("rest"))

    return rows.mapInArrow(run, _state_schema(rows))


def next_state(state: DataFrame, entries: np.ndarray, before: np.ndarray, had: int, keep: int) -> DataFrame:
    """The state after the codebooks went from ``before`` to ``entries``; ``had`` bounds were kept, ``keep`` will be."""
    width = entries.shape[2]
    moved = np.sqrt(((entries - before).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                parts = _unpacked(part.column("vector"), "<i4", PARTS, width).astype(np.int64)
                code, ids = _unpacked(part.column("code"), "u1", PARTS), _unpacked(part.column("ids"), "u1", PARTS, had)
                lower, outer = _unpacked(part.column("lower"), "<f4", PARTS, had), _unpacked(part.column("outer"), "<f4", PARTS)
                done = [reassign(parts[:, p], entries[p], moved[p], Bounds(code[:, p].astype(np.int64), ids[:, p], lower[:, p], outer[:, p]), keep) for p in range(PARTS)]
                yield _state(parts, entries, [d[0] for d in done], np.stack([d[1] for d in done], axis=1), part.column("rest"))

    return state.mapInArrow(run, state.schema)


def entry_sums(state: DataFrame, entries: np.ndarray) -> DataFrame:
    """(part, entry, place, n, total): members of each entry and the sum of each component; place -1 has the members alone.

    A task sends one row per entry and component, whatever the number of its vectors.
    """
    count, width = entries.shape[1], entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((PARTS, count), np.int64), np.zeros((PARTS, count, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                parts, code = _unpacked(part.column("vector"), "<i4", PARTS, width).astype(np.int64), _unpacked(part.column("code"), "u1", PARTS)
                for p in range(PARTS):
                    order = np.argsort(code[:, p], kind="stable")
                    ids, first, members = np.unique(code[order, p], return_index=True, return_counts=True)
                    n[p, ids] += members
                    total[p, ids] += np.add.reduceat(parts[order, p], first, axis=0)
        p, e = np.nonzero(n)
        numbers = np.concatenate([n[p, e][:, None], total[p, e]], axis=1)
        places = np.tile(np.arange(-1, width), len(p))
        arrays = [np.repeat(p, width + 1), np.repeat(e, width + 1), places, numbers.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], ["part", "entry", "place", "total"])

    partial = state.select("vector", "code").mapInArrow(run, "part bigint, entry bigint, place bigint, total bigint")
    return partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def moved_codebooks(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Every entry that has members becomes the floor of their mean, component by component; the driver gets the codebooks' size."""
    sums = np.zeros((entries.shape[0], entries.shape[1], entries.shape[2] + 1), np.int64)
    for part, entry, place, total in entry_sums(state, entries).collect():
        sums[part, entry, place + 1] = total
    n, total = sums[:, :, :1], sums[:, :, 1:]
    return np.where(n > 0, total // np.maximum(n, 1), entries)


def bounds_to_keep(state: DataFrame, keep: int) -> int:
    """How many bounds the next round needs: all but ``OVER`` of the parts that used kept bounds had to look at no more."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.conv(F.hex(F.concat(F.substring("looked", 2 * p + 2, 1), F.substring("looked", 2 * p + 1, 1))), 16, 10).cast("int")))
    counts = dict(state.select(each.alias("looked")).groupBy("looked").count().collect())
    within = sorted((x, n) for x, n in counts.items() if x <= keep)
    allowed, over = OVER * sum(counts.values()), 0
    for x, n in reversed(within):
        over += n
        if over > allowed:
            return max(KEEP_LEAST, min(keep, x + 1))
    return min(keep, KEEP_LEAST)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS, keep: int = KEEP_FIRST) -> tuple[DataFrame, np.ndarray]:
    """(rest, code, error) of all kept rows, and the final codebooks (parts x entries x width).

    Rows whose vector is null or holds a null or non-finite component go. Components
    become floor(1024 * x), held within 2^24 so that sums are exact. Vectors are cut into four
    parts of equal width; shorter vectors and lengths that four does not divide are
    filled up with zeros, so an empty vector is one of zeros. The codebooks begin with
    the 256 least keys (null keys last, ties by the numbers; fewer rows give fewer
    entries), and in each round every part takes its nearest entry (ties to the lower
    index) and each entry with members becomes the floor of their mean. Equal rows are
    rows of their own. ``code`` has a byte for each part, ``error`` is the sum of its
    squared distances, ``rest`` a struct of all columns. An empty table gives no rows.

    Drake-Hamerly: each part's state, its closest entries with lower bounds and one
    outer bound, is a table that each round reads and writes anew; the number of
    bounds follows what the last round used. All comparisons that bounds leave open
    are made in integers. Codebooks (256 entries of the vectors' width) are all that the
    driver and every task hold.
    """
    spark = df.sparkSession
    root = scratch_path(spark, "vector-codes")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    rows, width = integer_rows(df, vector)
    entries = first_codebooks(rows, key, width)
    if not entries.shape[1]:
        return _empty(spark, rows), entries
    keep = max(1, min(keep, entries.shape[1] - 1)) if entries.shape[1] > 1 else 0
    state = kept(first_state(rows, entries, keep), "state-0")
    for r in range(1, rounds + 1):
        before, entries = entries, moved_codebooks(state, entries)
        had, keep = keep, min(keep, bounds_to_keep(state, keep)) if r > 1 else keep
        state = kept(next_state(state, entries, before, had, keep), f"state-{r}")
    return state.select("rest", "code", "error"), entries


def _empty(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return rows.where(F.lit(False)).select("rest", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))


def codebooks_digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def vector_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, its code, its error, the errors of its label, and the digest of the codebooks."""
    coded, entries = compress(embeddings.select("vec_id", "embedding", "label"))
    rows = coded.select("rest.vec_id", "code", "error", F.struct(F.col("rest.label").isNull().alias("none"), F.coalesce("rest.label", F.lit(0)).alias("value")).alias("label"))
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = join_per_key(rows, by_label, ["label"])
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(entries)).alias("codebooks_sha256"))
