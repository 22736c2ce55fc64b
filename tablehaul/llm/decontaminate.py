"""Benchmark items inside documents: size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tablehaul.llm.arrow import slices
from tablehaul.llm.shingles import block_minima, mixed, shingle_hashes, word_hashes
from tablehaul.session import scratch_path

SHINGLE, PERCENT = 5, 80
#: Probability that an item which a document holds is not proposed.
MISS = 1e-8
#: Bytes of benchmark text that are searched for in one pass; more text takes more passes.
ITEM_BLOCK_BYTES = 32 << 20
BITMAP_BITS = 22


def hash_functions(percent: int = PERCENT, miss: float = MISS) -> int:
    """How many hash functions keep the miss probability.

    An item of q shingles belongs to the class of the least power of two u >= q and
    is compared with blocks of u shingles. For one hash function, the chance that an
    item's minimum is also the minimum of a block is the sum over all blocks of
    |block & item| / |block | item|, at least (percent/100 q) / (u + q), and so at
    least (percent/100) / 3, wherever in the document the shingles are.
    """
    return math.ceil(math.log(miss) / math.log(1 - percent / 100 / 3))


@dataclass
class Items:
    """A block of benchmark items, indexed by size class."""

    ids: list
    shingles: list[set]
    hashes: list[np.ndarray]
    classes: dict[int, tuple[np.ndarray, np.ndarray]]  # size -> sorted keys and the items they belong to
    bitmaps: dict[int, np.ndarray]
    functions: int
    copies: list  # rows of the benchmark that an item stands for
    short: dict[int, dict[int, list[int]]]  # words -> hash of the sequence -> items of so many words


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingle_set(text: str, k: int = SHINGLE) -> set:
    """The distinct k-word shingles; none for a text of fewer words."""
    words = words_of(text)
    return set(zip(*[words[i:] for i in range(k)]))


def item_size(text: str, k: int = SHINGLE) -> int:
    """The words of an item's shingles: ``k``, or all words of a shorter item."""
    return min(k, len(words_of(text)))


def keys_of(values: np.ndarray) -> np.ndarray:
    """One number per (hash function, minimum); ``values`` is an array of blocks x functions."""
    return mixed((np.arange(values.shape[1], dtype=np.uint64)[None, :] << np.uint64(32)) | values.astype(np.uint64))


def index_items(rows: list[tuple], k: int = SHINGLE, percent: int = PERCENT, miss: float = MISS) -> Items:
    """``rows``: (id, text, copies). Items of fewer than k words are held by their whole sequence, the others by size class."""
    rows = [(i, text, copies) for i, text, copies in rows if text and words_of(text)]
    sizes = [item_size(text, k) for _, text, _ in rows]
    rows = [r for _, r in sorted(zip(sizes, rows), key=lambda x: x[0] < k)]  # short items last
    functions = hash_functions(percent, miss)
    found = Items([r[0] for r in rows], [shingle_set(r[1], item_size(r[1], k)) for r in rows], [], {}, {}, functions, [r[2] for r in rows], {})
    long = [r[1] for r in rows if item_size(r[1], k) == k]
    for n in range(1, k):
        members = [m for m in range(len(long), len(rows)) if item_size(rows[m][1], k) == n]
        if members:
            words, counts = word_hashes([rows[m][1].encode() for m in members])
            by_hash = found.short[n] = {}
            for m, h in zip(members, shingle_hashes(words, counts, n, short=False)[0].tolist()):
                by_hash.setdefault(h, []).append(m)
    if not long:
        return found
    words, counts = word_hashes([text.encode() for text in long])
    flat, shingles = shingle_hashes(words, counts, k, short=False)
    found.hashes = [np.unique(h) for h in np.split(flat, np.cumsum(shingles)[:-1])]
    lengths = np.array([len(h) for h in found.hashes])
    minima = block_minima(np.concatenate(found.hashes), np.cumsum(lengths) - lengths, functions)
    keys = keys_of(minima)
    classes = 1 << np.ceil(np.log2(lengths)).astype(int)
    for size in np.unique(classes).tolist():
        members = np.flatnonzero(classes == size)
        flat_keys, owners = keys[members].ravel(), np.repeat(members, functions)
        order = np.argsort(flat_keys, kind="stable")
        found.classes[size] = (flat_keys[order], owners[order])
        bitmap = np.zeros(1 << BITMAP_BITS, bool)
        bitmap[flat_keys >> np.uint64(64 - BITMAP_BITS)] = True
        found.bitmaps[size] = bitmap
    return found


def candidates(items: Items, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distinct pairs (text, item) whose minima agree in a block, as an array n x 2."""
    if not len(flat) or not items.classes:
        return np.zeros((0, 2), np.int64)
    pairs = []
    classes = sorted(items.classes)
    step = classes[0]
    blocks = -(-sizes // step)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * step
    minima = block_minima(flat, starts, items.functions)
    for size in classes:
        ratio = size // step
        if ratio > 1:  # blocks of a larger class are made of whole blocks of the last one
            first = np.flatnonzero(nth % ratio == 0)
            minima, owner, nth, step = np.minimum.reduceat(minima, first, axis=0), owner[first], nth[first] // ratio, size
        keys = keys_of(minima).ravel()
        maybe = np.flatnonzero(items.bitmaps[size][keys >> np.uint64(64 - BITMAP_BITS)])
        sorted_keys, owners = items.classes[size]
        low, high = (np.searchsorted(sorted_keys, keys[maybe], side) for side in ("left", "right"))
        hits = high - low
        if hits.sum():
            text = np.repeat(owner[maybe // items.functions], hits)
            place = np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
            pairs.append(np.unique(np.stack([text, owners[place]], axis=1), axis=0))
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def contained(items: Items, texts: list[str], k: int = SHINGLE, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) for each item whose shingles a text holds to ``percent`` or more, by the words themselves."""
    words, counts = word_hashes([t.encode() for t in texts])
    flat, sizes = shingle_hashes(words, counts, k, short=False)
    ends = np.cumsum(sizes)
    out, last, have = short_items(items, texts, words, counts), -1, set()
    for text, item in candidates(items, flat, sizes).tolist():
        total = len(items.shingles[item])
        near = np.isin(items.hashes[item], flat[ends[text] - sizes[text] : ends[text]]).sum()
        if 100 * int(near) < percent * total:  # equal words have equal hashes, so this only drops what can't pass
            continue
        if text != last:
            last, have = text, shingle_set(texts[text], k)
        shared = len(items.shingles[item] & have)
        if 100 * shared >= percent * total:
            out.append((text, item, shared))
    return out


def short_items(items: Items, texts: list[str], words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, 1) for each item of fewer words than a shingle whose words a text holds one after the other."""
    out = []
    for n, by_hash in items.short.items():
        flat, sizes = shingle_hashes(words, counts, n, short=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(np.isin(flat, np.fromiter(by_hash, np.uint64, len(by_hash))))
        pairs = sorted({(t, m) for t, h in zip(owner[at].tolist(), flat[at].tolist()) for m in by_hash[h]})
        for text, found in groupby(pairs, key=lambda p: p[0]):
            have = shingle_set(texts[text], n)
            out += [(text, m, 1) for _, m in found if items.shingles[m] <= have]
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark's distinct rows with their number, in blocks of about ``ITEM_BLOCK_BYTES``, so that neither driver nor task holds more."""
    spark = benchmark.sparkSession
    path = scratch_path(spark, "items")
    narrow = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    narrow.groupBy("item", "text").agg(F.count("*").alias("copies")).write.parquet(path)
    distinct = spark.read.parquet(path)
    total = distinct.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / ITEM_BLOCK_BYTES))
    for n in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == n)
        yield [(row.item, row.text, row.copies) for row in part.collect()]


def find_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``key``, ``item``, n_shared, n_shingles): each item of which a document holds ``PERCENT`` of the distinct shingles or more.

    Documents are read in place, once per block of items; nothing is shuffled.
    An item of fewer than five words is one shingle of all its words, so a document
    holds it that has these words one after the other. Null texts and texts and items without a word hold
    nothing and are in nothing. Equal rows, of documents or items, give equal results each; an
    empty benchmark gives none.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["_key"], T.StructField("_item", benchmark.schema[item].dataType), T.StructField("n_shared", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("_copies", T.LongType())])
    item_type = pa_type(benchmark, item)
    found = None
    for rows in item_blocks(benchmark, item, item_text):
        items = spark.sparkContext.broadcast(index_items(rows))

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                hits = contained(items.value, texts)
                arrays = [
                    part.column("_key").take(pa.array([h[0] for h in hits], pa.int64())),
                    pa.array([items.value.ids[h[1]] for h in hits], item_type),
                    pa.array([h[2] for h in hits], pa.int64()),
                    pa.array([len(items.value.shingles[h[1]]) for h in hits], pa.int64()),
                    pa.array([items.value.copies[h[1]] for h in hits], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

        one = narrow.mapInArrow(search, schema)
        found = one if found is None else found.unionAll(one)
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copy", "_copies")
    return each.withColumnsRenamed({"_key": key, "_item": item})


def pa_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Documents with a null, empty or blank text hold none; equal rows stay or go together; with an
    empty benchmark all stay. Items count as in :func:`find_items`.
    """
    spark = docs.sparkSession
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = names[docs.columns.index(text)]
    for rows in item_blocks(benchmark, item, item_text):
        items = spark.sparkContext.broadcast(index_items(rows))

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, at):
                hit = {h[0] for h in contained(items.value, [t or "" for t in part.column(at).to_pylist()])}
                yield part.filter(pa.array([i not in hit for i in range(part.num_rows)], pa.bool_())) if hit else part

        plain = plain.mapInArrow(clean, plain.schema)
    return plain.toDF(*docs.columns)
