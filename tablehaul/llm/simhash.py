"""SimHash near duplicates: candidates by chains of ring segments (pigeonring), full Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tablehaul.llm.arrow import slices
from tablehaul.llm.components import components
from tablehaul.operators.skew import join_per_key
from tablehaul.session import scratch_path

SHINGLE, BITS = 5, 4
SEED = 42
#: Members of a bucket that are compared in one piece; larger buckets are split by the next segment of their chain.
SIDE = 4096
#: Buckets of up to so many members are compared together with their neighbours, place by place.
FEW = 16
#: Words that are hashed at a time.
WORDS = 1 << 16
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def fingerprint(text: str, k: int) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if it is set in over half of its shingles' hashes.

    Shingles are ``k`` words joined by spaces, repeats included, A-Z lower-cased; a
    shorter text is one shingle, a text without words has fingerprint 0. Hashes are
    XXH64 with seed 42. Words are hashed in runs of ``WORDS``, so a very long text
    needs a few arrays of its length and no list of all its words.
    """
    raw = np.frombuffer(b" " + text.encode().lower() + b" ", np.uint8)
    white = _WHITE[raw]
    edge = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    if not len(starts):
        return 0
    keep = ~white
    keep[1:] |= ~white[:-1]  # the first white character after a word stands for all
    places = np.cumsum(keep) - 1
    line = np.where(white, np.uint8(32), raw)[keep].tobytes()
    starts, ends = places[starts], places[ends]
    size = min(k, len(starts))
    starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), WORDS):
        pieces = zip(starts[at : at + WORDS].tolist(), ends[at : at + WORDS].tolist())
        values = np.array([hashed(line[a:b], SEED) for a, b in pieces], np.uint64)
        counts += np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(id, f): the fingerprint of every whole text as a signed 64-bit number; a null text counts as empty."""
    narrow = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.array([fingerprint(t, k) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.view(np.int64))], ["id", "f"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], T.StructField("f", T.LongType())]))


def segments(bits: int) -> list[list[tuple[int, int]]]:
    """bits + 1 segments of a ring of 64 bits, each as two halves (first bit from the right, width)."""
    count = bits + 1
    edges = [64 * i // (2 * count) for i in range(2 * count + 1)]
    halves = [(edges[i], edges[i + 1] - edges[i]) for i in range(2 * count)]
    return [halves[2 * i : 2 * i + 2] for i in range(count)]


def chain_masks(start: int, bits: int) -> list[int]:
    """The bits of the first 1, 2, ... segments of the chain that begins at segment ``start``; all 64 at last."""
    ring, mask, out = segments(bits), 0, []
    for step in range(len(ring)):
        for low, width in ring[(start + step) % len(ring)]:
            mask |= ((1 << width) - 1) << low
        out.append(mask)
    return out


def first_buckets(nodes: DataFrame, bits: int) -> DataFrame:
    """(i, b, t, v): every fingerprint in one bucket for each segment a chain may begin with."""
    whole = [sum(((1 << w) - 1) << low for low, w in pair) for pair in segments(bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in whole]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), F.col("v").bitwiseAND(F.lit(m))).alias("b")) for i, m in enumerate(signed)])
    return nodes.select("v", F.explode(each).alias("e")).select("e.i", "e.b", F.lit(0).alias("t"), "v")


def next_buckets(members: DataFrame, level: int, bits: int) -> DataFrame:
    """Members of too large buckets, by one more half that is equal.

    In a chain whose first segment has no difference, the next ``level`` segments
    may differ in ``level`` bits, and the first l of them in l bits. So of the 2l
    first halves at least l are equal, for every l, and the pair shares a bucket for
    the first ``level`` equal halves. ``t`` is the number of the last of them: the
    next is one of t + 1 to 2 * level.
    """
    ring = segments(bits)
    halves = []
    for start in range(len(ring)):
        chain = [h for step in range(1, len(ring)) for h in ring[(start + step) % len(ring)]]
        halves.append(F.array(*[F.struct(F.lit(low).alias("low"), F.lit((1 << width) - 1).cast("long").alias("mask")) for low, width in chain]))
    steps = members.withColumn("n", F.explode(F.sequence(F.col("t") + 1, F.lit(2 * level))))
    half = steps.withColumn("half", F.get(F.get(F.array(*halves), F.col("i")), F.col("n") - 1))
    value = F.expr("shiftrightunsigned(v, half.low) & half.mask")
    return half.select("i", F.xxhash64("b", "n", value).alias("b"), F.col("n").alias("t"), "v")


def _close(a: np.ndarray, b: np.ndarray, masks: list[int], bits: int) -> np.ndarray:
    """Which pairs pass the budgets of their chain, segment after segment; the last step is the full Hamming check."""
    differ = a ^ b
    alive = np.arange(len(differ))
    for step, mask in enumerate(masks):
        # the budget of the first step + 1 of bits + 1 segments is in proportion: bits * (step + 1) / (bits + 1)
        budget = bits * (step + 1) // (bits + 1)
        alive = alive[np.bitwise_count(differ[alive] & np.uint64(mask)) <= budget]
    return alive


def _block_edges(left: np.ndarray, right: np.ndarray, masks: list[int], bits: int) -> list[tuple[int, int]]:
    """Edges that join what is linked between two lists of fingerprints, at most one per fingerprint."""
    near = np.zeros((len(left), len(right)), bool)
    strip = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), strip):
        part = left[at : at + strip]
        a, b = np.repeat(part, len(right)), np.tile(right, len(part))
        near[at : at + strip].ravel()[_close(a, b, masks, bits)] = True
    rows, columns = near.any(axis=1), near.any(axis=0)
    by_column = np.ascontiguousarray(near.T)
    new = columns.copy()  # right members that no tree has reached
    out = []
    for first in np.flatnonzero(rows).tolist():
        if not rows[first]:
            continue
        rows[first], queue, center = False, [(True, first)], int(left[first])
        while queue:
            is_left, x = queue.pop()
            reached = np.flatnonzero((near[x] & new) if is_left else (by_column[x] & rows)).tolist()
            (new if is_left else rows)[reached] = False
            other = right if is_left else left
            out += [(center, int(other[y])) for y in reached]
            queue += [(not is_left, y) for y in reached]
    return [(u, v) for u, v in out if u != v]


def links(buckets: DataFrame, bits: int) -> DataFrame:
    """(u, v): edges between fingerprints of one bucket (g: i, b, x, y, s, v) that make its linked members connected.

    Tasks get whole buckets, sorted, and hold at most two sides of one. Small buckets
    are compared together, neighbour by neighbour; in larger ones a tree per component
    comes out, so no task returns more than a few edges a member.
    """
    ready = buckets.repartition("b", "x", "y").sortWithinPartitions("i", "b", "x", "y", "s", "v")

    def few(i: np.ndarray, group: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for step in range(1, FEW):
            same = np.flatnonzero(group[step:] == group[:-step])
            if not len(same):
                break
            for start in np.unique(i[same]).tolist():
                at = same[i[same] == start]
                good = at[_close(v[at], v[at + step], chain_masks(start, bits), bits)]
                out += zip(v[good].tolist(), v[good + step].tolist())
        return out

    def work(rows: pa.Table) -> list[tuple[int, int]]:
        i, b, x, y, s = (rows.column(c).to_numpy() for c in ("i", "b", "x", "y", "s"))
        v = rows.column("v").to_numpy().view(np.uint64)
        new = np.concatenate([[True], (i[1:] != i[:-1]) | (b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        small = (sizes <= FEW)[group] & (x == y)
        out = few(i[small], group[small], v[small])
        ends = np.cumsum(sizes)
        whole = ~small[ends - sizes]
        for a, z in zip((ends - sizes)[whole].tolist(), ends[whole].tolist()):
            left = v[a:z][s[a:z] == x[a]]
            right = left if x[a] == y[a] else v[a:z][s[a:z] == y[a]]
            out += _block_edges(left, right, chain_masks(int(i[a]), bits), bits)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # what is before the last bucket of this batch is whole
            cut = batch.num_rows
            if cut:
                same = np.all([batch.column(c).to_numpy() == batch.column(c)[cut - 1].as_py() for c in ("i", "b", "x", "y")], axis=0)
                cut = int(np.flatnonzero(~same).max(initial=-1)) + 1
            if cut:
                yield _edges(work(pa.Table.from_batches([*held, batch.slice(0, cut)])))
                held = []
            held.append(batch.slice(cut))
        if held and sum(b.num_rows for b in held):
            yield _edges(work(pa.Table.from_batches(held)))

    return ready.select("i", "b", "x", "y", "s", "v").mapInArrow(run, "u bigint, v bigint").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["u", "v"])


def near_fingerprints(nodes: DataFrame, bits: int = BITS, side: int = SIDE) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of distinct fingerprints (v) with at most ``bits`` differing bits.

    Pigeonring: of bits + 1 segments on a ring, some chain begins where every prefix of
    l segments has at most its share bits * l / (bits + 1) of the differences; its
    first segment has none. So a pair meets in the bucket of that segment. Buckets of
    over ``side`` members are split by the next segment's budget, as often as needed;
    those still larger at the end of the ring are compared side by side in blocks.
    """
    spark = nodes.sparkSession
    root = scratch_path(spark, "simhash")
    members, ready = first_buckets(nodes, bits), []
    for level in range(bits + 1):
        members.write.parquet(f"{root}/level-{level}")
        members = spark.read.parquet(f"{root}/level-{level}")
        sizes = members.groupBy("b").agg(F.count("*").alias("m"))
        shared = join_per_key(members, sizes.where("m > 1"), ["b"], "inner")
        large = shared.where(F.col("m") > side) if level < bits else None
        here = shared if large is None else shared.where(F.col("m") <= side)
        sides = F.ceil(F.col("m") / F.lit(side)).cast("int")
        own = here.withColumn("g", sides).withColumn("s", F.pmod(F.xxhash64("v"), F.col("g")).cast("int"))
        dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        ready.append(dealt.select("i", "b", F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y"), "s", "v"))
        if large is None or sizes.where(F.col("m") > side).isEmpty():
            break
        members = next_buckets(large, level + 1, bits)
    out = ready[0]
    for more in ready[1:]:
        out = out.unionAll(more)
    return links(out, bits)


def group(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(id, f, component_id): every row with its fingerprint and the least id of its component.

    Fingerprints link at ``bits`` or fewer differing bits. Equal fingerprints are one
    node, so copies of any number cost no pairs. Null and empty texts and texts
    without words have fingerprint 0 and are linked like others; rows with a null
    id take part, and a component of null ids only has a null component_id; equal
    rows stay equal rows. An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    root = scratch_path(spark, "simhash-rows")
    fingerprints(df, key, text, k).write.parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")
    leads = rows.groupBy("f").agg(F.min("id").alias("lead"))
    leads.write.parquet(f"{root}/leads")
    leads = spark.read.parquet(f"{root}/leads")
    labels = components(near_fingerprints(leads.select(F.col("f").alias("v")), bits))
    named = leads.join(labels.withColumnRenamed("v", "f"), "f", "left").withColumn("c", F.coalesce("c", "f"))
    least = named.groupBy("c").agg(F.min("lead").alias("component_id"))
    per_fingerprint = join_per_key(named.select("f", "c"), least, ["c"]).drop("c")
    return join_per_key(rows, per_fingerprint, ["f"])


def simhash_rows(documents: DataFrame, k: int, bits: int) -> DataFrame:
    """doc_id, its fingerprint as 16 hex digits and its component."""
    found = group(documents.select("doc_id", "text"), k=k, bits=bits)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
