"""Near duplicates: banded MinHash, Bayesian pruning, exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablehaul.llm.arrow import slices
from tablehaul.llm.components import components
from tablehaul.llm.scratch import discard, shuffles_deleted
from tablehaul.llm.shingles import block_minima, mixed, shingle_hashes, word_hashes
from tablehaul.operators.skew import join_per_key
from tablehaul.session import scratch_path

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 32, 4  # a pair at 80 % is missed with probability (1 - 0.8^4)^32 = 5e-8
HASHES = BANDS * ROWS
BATCH = 16  # hash values compared before the next look at the posterior
MISS = 1e-6  # a pair is dropped when its similarity reaches the threshold with less than this probability


def distinct_shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted hashes, one text after the other, and their numbers."""
    words, counts = word_hashes([t.encode() for t in texts])
    flat, sizes = shingle_hashes(words, counts, k, short=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    if len(flat):
        new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])])
        flat, owner = flat[new], owner[new]
    return flat, np.bincount(owner, minlength=len(texts))


def signed(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, n, s1, s2, signature, text, rest): the size of the shingle set, 128 bits that name it, and its MinHash signature.

    Texts without a word have no name and no signature. ``rest`` holds the other
    columns and whether the text was null.
    """
    others = [F.col(c) for c in df.columns if c not in (key, text)]
    rest = F.struct((F.struct(*others) if others else F.lit(0)).alias("row"), F.col(text).isNull().alias("none"))
    narrow = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), rest.alias("rest"))
    fields = [narrow.schema["id"], T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("text", T.StringType()), narrow.schema["rest"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            flat, sizes = distinct_shingles(part.column("text").to_pylist(), k)
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            names = np.zeros((2, part.num_rows), np.uint64)
            minima = block_minima(flat, starts, HASHES) if len(some) else np.zeros((0, HASHES), np.uint32)
            if len(some):
                names[0, some] = np.add.reduceat(mixed(flat), starts)
                names[1, some] = np.add.reduceat(mixed(~flat), starts)
            none = sizes == 0
            signatures: list = [None] * part.num_rows
            for i, row in zip(some.tolist(), minima.astype("<u4")):
                signatures[i] = row.tobytes()
            arrays = [
                part.column("id"), pa.array(sizes.astype(np.int64)), pa.array(names[0].astype(np.int64), mask=none),
                pa.array(names[1].astype(np.int64), mask=none), pa.array(signatures, pa.binary()), part.column("text"), part.column("rest"),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "s1", "s2", "signature", "text", "rest"])

    return narrow.mapInArrow(run, T.StructType(fields))


def bands(signature: Column) -> Column:
    """The band keys of a signature as an array."""
    size = 4 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(signature, i * size + 1, size)))


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For BATCH, 2 BATCH, ... compared values: the fewest matches with which a pair stays.

    With a uniform prior, the similarity after m matches of n has the posterior
    Beta(m + 1, n - m + 1), and P(similarity >= t) is the chance of at most m
    successes in n + 1 trials of probability t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of signature rows stay; batch after batch only those still alive are compared."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, least in enumerate(least_matches(percent)):
        cut = slice(step * BATCH, (step + 1) * BATCH)
        matches[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def pruned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose similarity may reach the threshold by their signatures."""

    @F.pandas_udf("boolean")
    def may_link(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        if len(a):
            x, y = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), HASHES) for s in (a, b))
            out[survivors(x, y, percent)] = True
        return pd.Series(out)

    return _with_ends(pairs, nodes, "signature").where(may_link("a", "b")).select("u", "v")


def _with_ends(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """(u, v, a, b): both ends' values; a hub's many pairs are split."""
    left = nodes.select(F.col("v").alias("u"), F.col(column).alias("a"))
    right = nodes.select("v", F.col(column).alias("b"))
    return join_per_key(join_per_key(pairs, right, ["v"], "inner"), left, ["u"], "inner")


def linked(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) that are linked by their full shingle sets: 100 * |both| >= percent * |either|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(slices(batches, "a"), "b"):
            a, a_sizes = distinct_shingles(part.column("a").to_pylist(), k)
            b, b_sizes = distinct_shingles(part.column("b").to_pylist(), k)
            pairs_of = zip(np.split(a, np.cumsum(a_sizes)[:-1]), np.split(b, np.cumsum(b_sizes)[:-1]))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs_of], np.int64)
            good = 100 * both >= percent * (a_sizes + b_sizes - both)
            yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], ["u", "v"]).filter(pa.array(good))

    return _with_ends(pairs, nodes, "text").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


#: Buckets of so many members give their pairs to the verification; larger ones are verified where they are compared.
SMALL = 16
#: Members of a large bucket that one task compares with as many others at a time.
SIDE = 512


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key as a table, from batches in which equal keys are neighbours."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows]):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def signature_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), HASHES)


def small_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u < v) of one bucket but different components whose signatures may link them; for ``SMALL`` buckets."""
    full = join_per_key(members, nodes.select("v", "signature"), ["v"], "inner")
    ready = full.repartition("b").sortWithinPartitions("b", "v").select("b", "v", "c", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ("b",)):
            v, c = rows.column("v").to_numpy(), rows.column("c").to_numpy()
            signatures = signature_rows(rows.column("signature"))
            a, b = np.triu_indices(len(v), 1)
            apart = c[a] != c[b]
            a, b = a[apart], b[apart]
            stay = survivors(signatures[a], signatures[b], percent)
            yield pa.RecordBatch.from_arrays([pa.array(v[a[stay]]), pa.array(v[b[stay]])], ["u", "v"])

    return ready.mapInArrow(run, "u bigint, v bigint").distinct()


def block_pairs(c: np.ndarray, signatures: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows ``left`` and ``right`` (places, or the same twice) of different components that may be linked by their signatures.

    A pair belongs to the first band it agrees in, so other buckets leave it out.
    """
    keys = signatures.reshape(len(c), BANDS, ROWS)
    apart = c[left][:, None] != c[right][None, :]
    if left is right:
        apart &= np.triu(np.ones(apart.shape, bool), 1)
    for t in range(band):
        apart &= ~(keys[left, t][:, None, :] == keys[right, t][None, :, :]).all(axis=2)
    a, b = np.nonzero(apart)
    a, b = left[a], right[b]
    stay = survivors(signatures[a], signatures[b], percent)
    return a[stay], b[stay]


def block_links(v: np.ndarray, c: np.ndarray, signatures: np.ndarray, texts: list[str], left: np.ndarray, right: np.ndarray, band: int, k: int, percent: int) -> list[tuple[int, int]]:
    """Links between rows ``left`` and ``right`` that join different components.

    The likeliest pairs are verified first, and none whose ends earlier links have
    joined: at most one link per row comes out.
    """
    a, b = block_pairs(c, signatures, left, right, band, percent)
    if not len(a):
        return []
    order = np.argsort(-(signatures[a] == signatures[b]).sum(axis=1), kind="stable")
    needed, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    flat, sizes = distinct_shingles([texts[i] for i in needed], k)
    sets = np.split(flat, np.cumsum(sizes)[:-1])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    out = []
    for i in order.tolist():
        x, y = sets[at[i]], sets[at[len(a) + i]]
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            continue
        u, w = root(int(c[a[i]])), root(int(c[b[i]]))
        if u == w:
            continue
        both = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * both >= percent * (len(x) + len(y) - both):
            parent[max(u, w)] = min(u, w)
            out.append((int(min(v[a[i]], v[b[i]])), int(max(v[a[i]], v[b[i]]))))
    return out


BLOCK = ("b", "x", "y")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, int]]:
    """Each block's rows, the places of its two sides (the same array for one), and its band."""
    for rows in grouped(batches, BLOCK):
        s = rows.column("s").to_numpy()
        x, y, band = (rows.column(n)[0].as_py() for n in ("x", "y", "i"))
        left = np.flatnonzero(s == x)
        yield rows, left, left if x == y else np.flatnonzero(s == y), band


def in_blocks(dealt: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """The members of blocks with these columns of their nodes; blocks are whole in a task, one after the other."""
    full = join_per_key(dealt, nodes.select("v", *columns), ["v"], "inner")
    return full.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "v").select("b", "i", "x", "y", "s", "v", "c", *columns)


def needed_members(dealt: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The members of each block that its signatures may link with another; most buckets of unlike texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, left, right, band in _blocks(batches):
            pairs = block_pairs(rows.column("c").to_numpy(), signature_rows(rows.column("signature")), left, right, band, percent)
            stay = np.unique(np.concatenate(pairs))
            if len(stay):
                yield from rows.select(["b", "i", "x", "y", "s", "v", "c"]).take(pa.array(stay)).combine_chunks().to_batches()

    fields = [dealt.schema[c] for c in ("b", "i", "x", "y", "s", "v", "c")]
    return in_blocks(dealt, nodes, ["signature"]).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def dense_links(members: DataFrame, sizes: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u < v) that join components of one large bucket.

    Members (b, i, v, c) are cut into sides of about ``SIDE`` per bucket; every two
    sides are compared in one task, by signatures first. Texts are then dealt only to
    the blocks in which a member has a pair left, and compared by their full sets. So
    no task holds more than two sides, and only links are rows, not pairs.
    """
    sides = sizes.select("b", F.ceil(F.col("m") / F.lit(SIDE)).cast("int").alias("g"))
    split = join_per_key(members, sides, ["b"], "inner").withColumn("s", F.pmod(F.xxhash64("v"), F.col("g")).cast("int"))
    dealt = split.select("v", "c", "s", "b", "i", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    dealt = dealt.select("v", "c", "s", "b", "i", F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, left, right, band in _blocks(batches):
            v, c = rows.column("v").to_numpy(), rows.column("c").to_numpy()
            found = block_links(v, c, signature_rows(rows.column("signature")), rows.column("text").to_pylist(), left, right, band, k, percent)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["u", "v"])

    needed = needed_members(dealt, nodes, percent)
    return in_blocks(needed, nodes, ["signature", "text"]).mapInArrow(run, "u bigint, v bigint").distinct()


def cross_links(members: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Every link that may join different components of one bucket, or enough of them to join the same."""
    sizes = members.groupBy("b").agg(F.count("*").alias("m"))
    sized = join_per_key(members, sizes, ["b"], "inner")
    small = small_pairs(sized.where(F.col("m") <= SMALL).drop("m", "i"), nodes, percent)
    large = dense_links(sized.where(F.col("m") > SMALL).drop("m"), sizes, nodes, k, percent)
    return linked(small, nodes, k, percent).unionAll(large)


def relabel(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(b, i, v, c) of the buckets that hold two components or more."""
    if labels is None:
        known = members.withColumn("c", F.col("v"))
    else:
        known = join_per_key(members, labels, ["v"]).withColumn("c", F.coalesce("c", "v"))
    mixed_up = known.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("b")
    return join_per_key(known, mixed_up, ["b"], "inner")


def hub_pairs(members: DataFrame, turn: int) -> DataFrame:
    """One pair (u < v) at most for each node: with the hub of one of its buckets, if that is in another component.

    A bucket's hub is its least node in a random order that changes with ``turn``.
    So a group of near copies of any size costs as many pairs as it has members.
    """
    order = F.xxhash64(F.lit(turn), F.col("v")) if turn else F.col("v")
    ranked = members.withColumn("o", order)
    hubs = ranked.groupBy("b").agg(F.min(F.struct("o", "v", "c")).alias("hub"))
    met = join_per_key(ranked, hubs, ["b"], "inner").where("c <> hub.c")
    one = met.groupBy("v").agg(F.min(F.struct(F.col("hub.o"), F.col("hub.v"))).alias("hub"))
    return one.select(F.least("v", "hub.v").alias("u"), F.greatest("v", "hub.v").alias("v")).distinct()


HUB_TURNS = 2


def group(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(rid, id, n, text, rest, component_id, first): every row with its group of near duplicates.

    Two texts are linked when their sets of ``k``-word shingles (lower-cased A-Z,
    words between white space; the whole sequence of a shorter text) have at least
    ``percent`` in common; groups are the components of the links.

    Equal sets become one node, so exact copies cost no pairs. Banded MinHash puts
    nodes into buckets. In each bucket a hub is compared first, one pair a node; what
    is then in different components is compared in blocks inside tasks, which return
    links and not pairs. All
    comparisons are sequential: signatures batch by batch, dropped when the posterior
    says so (chance ``MISS`` at most), then exact sets for the rest. Sets are compared
    by 64-bit shingle hashes and named by 128 bits.

    ``component_id`` is the least non-null id in the group, ``first`` the number (rid)
    of the row that has it. Rows without a word are groups of their own; a null id
    is a document like others; equal rows are in one group. Intermediate tables are
    written below the shared scratch folder.
    """
    spark = df.sparkSession
    root = scratch_path(spark, "near-dup")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    with shuffles_deleted(spark):
        rows = kept(signed(df, key, text, k).withColumn("rid", F.monotonically_increasing_id()), "rows")
        lead = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
        classes = rows.where("s1 is not null").groupBy("s1", "s2").agg(F.first("signature").alias("signature"), F.min(lead).alias("lead"))
        classes = kept(classes.withColumn("v", F.monotonically_increasing_id()), "classes")

        banded = classes.select("v", F.posexplode(bands(F.col("signature"))).alias("i", "b"))
        shared = banded.groupBy("b").agg(F.count("*").alias("m")).where("m > 1").select("b")
        members = kept(join_per_key(banded, shared, ["b"], "inner"), "members")
        wanted = classes.join(members.select("v").distinct(), "v", "left_semi").select("s1", "s2", "v", "signature")
        texts = join_per_key(rows.where("s1 is not null").select("s1", "s2", "text"), wanted, ["s1", "s2"], "inner")
        nodes = kept(texts.groupBy("v").agg(F.first("signature").alias("signature"), F.first("text").alias("text")), "nodes")

        links, labels = None, None
        for turn in range(HUB_TURNS + 1):
            apart = relabel(members, labels)
            if turn < HUB_TURNS:
                found = linked(pruned(hub_pairs(apart, turn), nodes, percent), nodes, k, percent)
            else:
                found = cross_links(kept(apart, "apart"), nodes, k, percent)
            found = kept(found, f"links-{turn}")
            links = found if links is None else links.unionAll(found)
            labels = components(links)
    # the labels are checkpointed and each turn's links are read no more
    discard(spark, *[f"{root}/{name}" for name in ("nodes", "members", "apart")])

    per_class = join_per_key(classes.select("v", "s1", "s2", "lead"), labels, ["v"]).withColumn("c", F.coalesce("c", "v"))
    leads = per_class.groupBy("c").agg(F.min("lead").alias("group_lead"))
    named = join_per_key(per_class.select("s1", "s2", "c"), leads, ["c"]).drop("c")
    joined = join_per_key(rows.drop("signature"), named, ["s1", "s2"])
    return joined.select(
        "rid", "id", "n", "text", "rest",
        F.when(F.col("group_lead").isNull(), F.col("id")).otherwise(F.col("group_lead.id")).alias("component_id"),
        F.coalesce("group_lead.rid", "rid").alias("first"),
    )


def near_dup_rows(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, the size of its shingle set, its component and whether it is the one that stays."""
    found = group(documents.select("doc_id", "text"), k=k, percent=percent)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each group of near duplicates, with the columns of ``df``; equal rows are copies too."""
    found = group(df, key, text).where("rid = first")
    back = {key: F.col("id"), text: F.when(~F.col("rest.none"), F.col("text"))}
    return found.select(*[back[c].alias(c) if c in back else F.col("rest.row")[c].alias(c) for c in df.columns])
