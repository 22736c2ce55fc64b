"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablehaul.operators.skew import join_per_key
from tablehaul.session import scratch_path

WORD = r"[^ \t-\r]+"
#: Bytes that name a turn: half a sha-256 of its role and text.
TURN = 16
#: Turns of paths that a shard holds, beyond its last path.
SHARD_TURNS = 1 << 18
#: Parentheses in a block of the range min-max directory.
BLOCK = 64
#: Ids of a path are joined in ranges of 2^9 ids before they are hashed.
ID_RANGE_BITS = 9
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversation_paths(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, path, words): each conversation as the names of its turns, one after the other, and the words of each turn.

    Turns are ordered by ``turn``, null first, and by their names where it is the
    same, so repeated rows are turns of their own. Null roles and texts are empty;
    rows without a conversation id belong to no conversation. A text is read whole
    and leaves the scan as 16 bytes. One conversation is one row of about 24 bytes a turn.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    who = F.coalesce(F.col(role), F.lit(""))
    name = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * TURN)
    n_words = F.regexp_count(said, F.lit(WORD))
    turns = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.struct(F.col(turn).isNotNull(), F.col(turn), name.alias("name"), n_words.alias("words")).alias("t")
    )
    whole = turns.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("t"))
    path = F.unhex(F.array_join("t.name", ""))
    return whole.select("c", path.alias("path"), F.col("t.words").alias("words"))


def with_shared_heads(paths: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % every; h = crc32(decimal c) % heads.

    All turns of that conversation if it has fewer, none if it is absent; then c's own
    turns after its first h. At most ``every`` conversations share a head, so no key is hot.
    """
    most = heads - 1
    donors = paths.where(F.col("c") % every == 0).select(
        F.col("c").alias("d"), F.substring("path", 1, most * TURN).alias("head"), F.slice("words", 1, most).alias("head_words")
    )
    own = paths.withColumn("d", F.col("c") - F.col("c") % every).withColumn("h", (F.crc32(F.col("c").cast("string")) % heads).cast("int"))
    joined = own.join(donors, "d", "left")
    path = F.concat(F.expr(f"substring(coalesce(head, X''), 1, h * {TURN})"), F.expr(f"substring(path, h * {TURN} + 1, length(path))"))
    words = F.concat(F.expr("slice(coalesce(head_words, array()), 1, h)"), F.expr("slice(words, h + 1, greatest(size(words) - h, 0))"))
    return joined.select("c", path.alias("path"), words.alias("words"))


def path_ends(paths: DataFrame) -> DataFrame:
    """(c, n, ends): the least conversation of each distinct path, their number, and the sha-256 of their ids.

    The ids of a path are joined in ranges first and then streamed
    through the hash in order, so a path of any number of copies needs no more memory
    than one range. The stream of one path can't be split, as a sha-256 is one chain;
    it moves ids alone.
    """
    in_range = paths.select(F.sha2("path", 256).alias("p"), F.shiftright("c", ID_RANGE_BITS).alias("r"), "c").groupBy("p", "r").agg(F.sort_array(F.collect_list("c")).alias("ids"))
    ready = in_range.select("p", "r", F.get("ids", F.lit(0)).alias("c"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ready = ready.repartition("p").sortWithinPartitions("p", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, c, n, digest = None, 0, 0, hashlib.sha256()
        done: list[tuple[int, int, str]] = []
        for batch in batches:
            for p, first, count, ids in zip(*(batch.column(x).to_pylist() for x in ("p", "c", "n", "ids"))):
                if p != last:
                    if last is not None:
                        done.append((c, n, digest.hexdigest()))
                    last, c, n, digest = p, first, 0, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
                n += count
            yield _batch(done)
            done = []
        if last is not None:
            yield _batch([(c, n, digest.hexdigest())])

    def _batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        c, n, ends = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(ends, pa.string())], ["c", "n", "ends"])

    return ready.mapInArrow(run, "c bigint, n bigint, ends string")


class Parentheses:
    """A tree as balanced parentheses with a range min-max directory over its excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.opens = np.flatnonzero(bits)
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int32)
        padded = np.pad(self.excess, (0, -len(bits) % BLOCK), constant_values=np.iinfo(np.int32).max)
        #: least excess of every block, of every two blocks, of every four ...
        self.least = [padded.reshape(-1, BLOCK).min(axis=1)]
        while len(self.least[-1]) > 1:
            level = self.least[-1]
            level = np.pad(level, (0, len(level) % 2), constant_values=np.iinfo(np.int32).max)
            self.least.append(level.reshape(-1, 2).min(axis=1))

    def _scan(self, at: np.ndarray, goal: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Put the first place from ``at`` on, in its block, with the excess ``goal`` into ``out``; returns which have none."""
        at, left, missed = at.copy(), np.arange(len(at)), []
        while len(left):
            hit = self.excess[at[left]] == goal[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            over = (at[left] % BLOCK == 0) | (at[left] == len(self.bits))
            missed.append(left[over])
            left = left[~over]
        return np.concatenate([np.zeros(0, np.int64), *missed])

    def find_close(self) -> np.ndarray:
        """The place of the closing parenthesis of every opening one, in order of the opening ones.

        The first place after it whose excess is one less: looked for in its own block,
        then in the least excess of ever larger groups of blocks to the right, then down
        to the block that has it.
        """
        goal = self.excess[self.opens] - 1
        out = np.zeros(len(goal), np.int64)
        missed = self._scan(self.opens, goal, out)
        if not len(missed):
            return out
        node, want = self.opens[missed] // BLOCK, goal[missed]
        height, found, climbing = np.zeros(len(missed), np.int64), np.zeros(len(missed), np.int64), np.arange(len(missed))
        for h, level in enumerate(self.least):
            here = node[climbing]
            reach = np.zeros(len(here), bool)
            right = (here % 2 == 0) & (here + 1 < len(level))
            reach[right] = level[here[right] + 1] <= want[climbing[right]]
            done = climbing[reach]
            found[done], height[done] = node[done] + 1, h
            climbing = climbing[~reach]
            node[climbing] //= 2
        for h in range(len(self.least) - 1, 0, -1):
            down = np.flatnonzero(height == h)
            child = 2 * found[down]
            found[down] = child + (self.least[h - 1][child] > want[down])
            height[down] = h - 1
        close = np.zeros(len(missed), np.int64)
        self._scan(found * BLOCK, want, close)
        out[missed] = close
        return out

    def leaf_rank(self) -> np.ndarray:
        """For every place, the number of pairs "()" that begin before it."""
        pair = np.zeros(len(self.bits) + 1, np.int64)
        pair[1:-1] = self.bits[:-1] & ~self.bits[1:]
        return np.cumsum(pair)


def common_turns(a: bytes, b: bytes) -> int:
    """The number of turns with which both paths begin."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    return int((x != y).argmax()) // TURN


def spine_names(path: bytes) -> list[bytes]:
    """The names of all prefixes of a path, from the empty one."""
    rolling, out = hashlib.blake2b(digest_size=16), []
    out.append(rolling.copy().digest())
    for i in range(0, len(path), TURN):
        rolling.update(path[i : i + TURN])
        out.append(rolling.copy().digest())
    return out


NODE = (
    "shard bigint, side int, depth bigint, name binary, above binary, conv_id bigint, parent_conv_id bigint, parent_side int, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, words bigint, ends string"
)


def shard_nodes(shard: int, paths: list[bytes], convs: np.ndarray, copies: np.ndarray, ends: list[str], words: list[np.ndarray]) -> pa.RecordBatch:
    """The nodes of one shard: ``paths`` are distinct and sorted, ``copies`` tells how many conversations each has.

    Nodes on the first and on the last path (its spines, sides 0 and 1) may go on in
    other shards. Their rows hold what this shard adds to them from nodes off the
    spines; all other rows (side -1) are whole.
    """
    count = len(paths)
    length = np.array([len(p) // TURN for p in paths], np.int64)
    shared = np.zeros(count, np.int64)
    for i in range(1, count):
        shared[i] = common_turns(paths[i - 1], paths[i])
    # preorder: the root, then what each path adds to the path before it
    new = length - shared
    n_nodes = 1 + int(new.sum())
    first = 1 + np.cumsum(new) - new
    owner = np.repeat(np.arange(count), new)
    depth = np.zeros(n_nodes, np.int64)
    depth[1:] = np.arange(n_nodes - 1) - (first[owner] - 1) + shared[owner] + 1
    parent = np.arange(-1, n_nodes - 1)
    end = np.zeros(count, np.int64)
    spine = np.zeros(int(length.max(initial=0)) + 1, np.int64)  # node of each depth on the path just read
    for i in range(count):
        if new[i]:
            parent[first[i]] = spine[shared[i]]
            spine[shared[i] + 1 : length[i] + 1] = np.arange(first[i], first[i] + new[i])
        end[i] = spine[length[i]]
        if i == 0:
            left = spine[: length[0] + 1].copy()
    right = spine[: length[-1] + 1].copy()
    node_words = np.zeros(n_nodes, np.int64)
    node_words[1:] = np.concatenate([w[s:] for w, s in zip(words, shared.tolist())]) if n_nodes > 1 else 0

    # parentheses: close what a path leaves, open what it adds
    closing = np.concatenate([[0], length[:-1] - shared[1:]])
    runs = np.empty(2 * count + 2, np.int64)
    runs[0], runs[-1] = 1, length[-1] + 1
    runs[1:-1:2], runs[2:-1:2] = closing, new
    tree = Parentheses(np.repeat(np.arange(len(runs)) % 2 == 0, runs))
    close = tree.find_close()
    after = (close - tree.opens + 1) // 2 + np.arange(n_nodes)  # the next node in preorder outside the subtree

    def below(values: np.ndarray) -> np.ndarray:
        cumulative = np.concatenate([[0], np.cumsum(values)])
        return cumulative[after] - cumulative[:-1]

    ending = np.zeros(n_nodes, np.int64)
    ending[end] = copies
    n_convs = below(ending)
    # the paths of a subtree are neighbours, so its least conversation is a minimum over a range of paths
    places = np.cumsum(np.concatenate([[0], np.bincount(end, minlength=n_nodes)]))
    ranges = np.stack([places[:-1], places[after]], axis=1).ravel()
    least = np.minimum.reduceat(np.append(convs, np.iinfo(np.int64).max), ranges)[::2]
    ranks = tree.leaf_rank()
    leaves = ranks[close] - ranks[tree.opens]

    side = np.full(n_nodes, -1, np.int32)
    side[right], side[left] = 1, 0
    off = side < 0
    n_children = np.bincount(parent[1:][off[1:]], minlength=n_nodes)
    saved = below(np.where(off, (n_convs - 1) * node_words, 0))
    # a leaf on a spine may have children elsewhere, so it is counted when the spines are merged
    is_leaf = np.zeros(n_nodes, bool)
    is_leaf[tree.opens.searchsorted(np.flatnonzero(tree.bits[:-1] & ~tree.bits[1:]))] = True
    leaves = leaves - below(is_leaf & ~off)
    end_text = np.full(n_nodes, None, object)
    end_text[end] = ends

    rows = np.concatenate([np.flatnonzero(off), left, right])
    sides = np.concatenate([np.full(int(off.sum()), -1), np.zeros(len(left), np.int64), np.ones(len(right), np.int64)]).astype(np.int32)
    again = np.zeros(len(rows), bool)  # on the last path, but already in the rows of the first
    again[len(rows) - len(right) :] = side[right] == 0
    up = parent[rows]
    above_off = (up >= 0) & off[up]
    names = [None] * int(off.sum()) + spine_names(paths[0]) + spine_names(paths[-1])
    above: list = [None] * int(off.sum())
    for n in (len(left), len(right)):
        at = len(above)
        above += [None] + names[at : at + n - 1]
    zero = lambda values: pa.array(np.where(again, 0, values[rows]).astype(np.int64))
    text = end_text[rows]
    text[again] = None
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(rows), shard, np.int64)), pa.array(sides), pa.array(depth[rows]), pa.array(names, pa.binary()), pa.array(above, pa.binary()),
            pa.array(least[rows]), pa.array(np.where(above_off, least[up], 0), mask=~above_off), pa.array(np.where(up >= 0, side[up], 0).astype(np.int32), mask=up < 0),
            zero(n_convs), zero(n_children), zero(leaves), zero(saved), pa.array(node_words[rows]), pa.array(text.tolist(), pa.string()),
        ],
        [f.split()[0] for f in NODE.split(", ")],
    )


def _shards(turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[list] = [[], [], [], [], []]
        size = 0

        def cut() -> pa.RecordBatch:
            paths, convs, copies, ends, words = held
            return shard_nodes(base + number, paths, np.array(convs, np.int64), np.array(copies, np.int64), ends, words)

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("path", "c", "n", "ends", "words"))):
                for kept, value in zip(held, row):
                    kept.append(value)
                held[-1][-1] = np.array(row[-1], np.int64)
                size += len(row[0]) // TURN + 1
                if size >= turns:
                    yield cut()
                    held, size, number = [[], [], [], [], []], 0, number + 1
        if size:
            yield cut()

    return run


def trie_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``paths`` (c, path, words), as :func:`conversation_paths` makes them.

    conv_id (the least conversation that goes through the node), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes
    of the subtree), saved_tokens (over the subtree, (n_convs - 1) times the words of
    the node's last turn) and ends_sha256 (of the ids that end there, ascending, with
    commas between).

    Equal paths become one row with its number of copies. Distinct paths are sorted
    over all tasks; every task cuts its sorted run into shards of ``shard_turns`` turns
    and encodes each as balanced parentheses: ``find_close`` delimits subtrees,
    ranks of "()" count leaves, cumulative arrays give conversations and savings. What
    shards share are prefixes of the paths at their edges. Those spines, two paths a
    shard, are merged by name: their values are added, then each spine's sums from
    its end upwards are added to all nodes above. So a prefix that all conversations
    share costs two rows a shard.

    Empty conversations end at the root; without a conversation there is no row.
    """
    spark = paths.sparkSession
    root = scratch_path(spark, "prefix-trie")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    paths = kept(paths.select("c", "path", "words"), "paths")
    distinct = kept(path_ends(paths).join(paths, "c"), "distinct")
    run = distinct.select("path", "c", "n", "ends", "words").repartitionByRange("path").sortWithinPartitions("path")
    nodes = kept(run.mapInArrow(_shards(shard_turns), NODE), "nodes")

    spines = nodes.where("side >= 0")
    merged = spines.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.first("words").alias("words"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("hung"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"),
        F.min(F.struct("shard", "side")).alias("owner"),
    )
    merged = kept(merged, "spines")
    beneath = merged.where("above is not null").groupBy(F.col("above").alias("name")).agg(F.count("*").alias("on_spine"))
    whole = join_per_key(merged, beneath, ["name"]).withColumn("n_children", F.col("hung") + F.coalesce("on_spine", F.lit(0)))
    whole = kept(whole.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "whole")
    # each node counts on one spine that goes through it; from the end upwards, a spine's sums go to all it passes
    places = join_per_key(spines.select("name", "shard", "side", "depth"), whole.select("name", "conv_id", "owner", "leaf", "own"), ["name"], "inner")
    mine = F.col("owner") == F.struct("shard", "side")
    upwards = "(PARTITION BY shard, side ORDER BY depth DESC ROWS UNBOUNDED PRECEDING)"
    summed = places.withColumn("mine", mine.cast("long")).select(
        "name", F.expr(f"sum(mine * leaf) OVER {upwards}").alias("more_leaves"), F.expr(f"sum(mine * own) OVER {upwards}").alias("more_saved")
    )
    added = summed.groupBy("name").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    parents = whole.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    on_spine = join_per_key(join_per_key(whole, added, ["name"]), parents, ["above"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"), "ends",
    )
    # a node that hangs on a spine finds its parent by shard, side and depth: no more rows than the shard has
    here = places.select("shard", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("spine_conv_id"))
    off = nodes.where("side < 0")
    inner = off.where("parent_conv_id is not null")
    hung = off.where("parent_conv_id is null").drop("parent_conv_id").join(here.withColumnRenamed("spine_conv_id", "parent_conv_id"), ["shard", "parent_side", "depth"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    rows = inner.select(columns).unionAll(hung.select(columns)).unionAll(on_spine.select(columns))
    return rows.select(*columns[:-2], F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def trie_rows(conversations: DataFrame) -> DataFrame:
    """The nodes of all conversations after every one has taken over its shared head."""
    return trie_nodes(with_shared_heads(conversation_paths(conversations)))
