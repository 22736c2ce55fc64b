"""Class-based bigram language model: classes by exchange clustering, scores by class transitions and word emissions."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablehaul.llm.arrow import slices
from tablehaul.llm.frequent import most_frequent
from tablehaul.llm.shingles import Lookup, word_hashes_and_ends
from tablehaul.session import scratch_path

# Parameters of the model; they bound what driver and tasks hold, whatever the corpus.
CLUSTERED = 8192  # most frequent words, which exchange clustering assigns to classes; every other word joins one of these
CLASSES = 64  # at least; their number grows with the vocabulary, see class_number
PER_ROOT = 2.5  # classes for each unit of the fourth root of the number of distinct words
ENDINGS = 32  # classes of all other words until they are assigned, by their last byte
HELD = 262_144  # most frequent words whose counts every task holds; the others' are joined
ROUNDS = 6  # of exchanging at most; it ends earlier when fewer than one word in SETTLED moves
SETTLED = 100
ADD = 0.1  # added to every word's count, as in the base score
BACK = 2.0  # weight of the class frequencies in a transition

#: Bytes of texts or tokens that are worked on at a time; the tables of a task are small beside them.
SLICE = 1 << 20

END, FIRST_ENDING, FIRST_CLASS = 0, 1, 1 + ENDINGS  # the exchange classes come last, as their number varies


def class_number(distinct: int) -> int:
    """Classes for so many distinct words: 64 up to 400,000, 140 for 10 million, 440 for a billion; no upper limit.

    The tables of pairs grow with the square root of the vocabulary, those of a clustered
    word's neighbours with its fourth root.
    """
    return max(CLASSES, round(PER_ROOT * distinct**0.25))


def is_held_out(key: str):
    """crc32 of the id as text is 0 modulo 10; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(10)) == 0


@dataclass
class Model:
    """Everything a task needs: bounded by the parameters above, but for the number of classes."""

    hashes: np.ndarray  # of the HELD words, sorted
    counts: np.ndarray
    word: np.ndarray  # rank of a clustered word, else -1
    endings: np.ndarray  # last bytes
    assigned: np.ndarray  # class of each clustered word, by rank
    width: int  # number of all classes: the end, the endings, the exchange classes
    tokens: int = 0
    distinct: int = 0
    ends: int = 0  # training texts
    transition: np.ndarray | None = None  # log10 P(class | class before)
    below: np.ndarray | None = None  # log10 of each class's emission denominator
    pairs: np.ndarray | None = None  # counts of class pairs
    every: np.ndarray | None = None  # class of each held word, once all words are assigned
    unseen: np.ndarray | None = None  # class of a word that training lacks, by its ending

    def classes(self) -> np.ndarray:
        """The class of each held word."""
        if self.every is not None:
            return self.every
        out = FIRST_ENDING + (self.endings.astype(np.int64) % ENDINGS)
        known = self.word >= 0
        out[known] = self.assigned[self.word[known]]
        return out


def count_words(train: DataFrame) -> DataFrame:
    """(h, e, n): every word's hash, last byte and count, summed per slice of a task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, e, n = (np.concatenate(x) for x in zip(*held))
            unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            sums = np.bincount(inverse, weights=n).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(e[first].astype(np.int32)), pa.array(sums)], ["h", "e", "n"])

        for part in slices(batches, "text", SLICE):
            h, _, e = word_hashes_and_ends([t.encode() for t in part.column("text").to_pylist()])
            unique, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((unique, e[first], n))
            size += len(unique)
            if size > 2_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return train.mapInArrow(count, "h bigint, e int, n bigint").groupBy("h").agg(F.max("e").alias("e"), F.sum("n").alias("n"))


def encode(rows: DataFrame, model: Model, path: str) -> DataFrame:
    """The columns of ``rows`` but ``text``, and its tokens, written to ``path``: each text is cut and looked up once.

    ``codes`` has a 32-bit number per word: its place among the held words, or -1 - its
    ending; ``rest`` the 64-bit hashes of the words that aren't held, in order.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "text"]
    fields = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names), "codes binary, rest binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value.hashes)
        for part in slices(batches, "text", SLICE):
            h, counts, e = word_hashes_and_ends([t.encode() for t in part.column("text").to_pylist()])
            place = lookup.find(h)
            other = place < 0
            codes = np.where(other, -1 - (e.astype(np.int64) % ENDINGS), place).astype("<i4")
            edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
            rest, sizes = h[other], np.concatenate([[0], np.cumsum(other)])[edges].tolist()
            cut = lambda x, at: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], cut(codes, edges), cut(rest, sizes)], [*names, "codes", "rest"])

    rows.mapInArrow(run, fields).write.parquet(path)
    return spark.read.parquet(path)


def sequence(model: Model, classes: np.ndarray, part: pa.RecordBatch):
    """All tokens of encoded texts in order, each text closed by an end: classes, places of held words, the words' hashes and where they are, tokens per text.

    The end of one text is also the state before the next, so neighbours in the
    arrays are all the pairs there are.
    """
    codes, rest = part.column("codes").to_pylist(), part.column("rest").to_pylist()
    counts = np.array([len(x) // 4 for x in codes], np.int64)
    place = np.frombuffer(b"".join(codes), "<i4").astype(np.int64)
    found = place >= 0
    h = np.zeros(len(place), np.uint64)
    h[found] = model.hashes[place[found]]
    h[~found] = np.frombuffer(b"".join(rest), np.uint64)
    sizes = counts + 1
    at = np.arange(len(place)) + np.repeat(np.arange(len(counts)), counts)
    own = FIRST_ENDING - 1 - place
    own[found] = classes[place[found]]
    cls = np.zeros(int(sizes.sum()), np.int64)
    cls[at] = own
    return cls, np.where(found, place, -1), h, at, sizes


def word_pairs(train: DataFrame, model: Model) -> np.ndarray:
    """How often each code follows each other one in the encoded texts: rows before, columns after.

    A clustered word's code is ``FIRST_CLASS`` + its rank; all else has its class, which is
    an ending or the end. Pairs are summed in tasks and between them, so what reaches the driver, packed, is
    at most one cell for each pair of codes, 270 MB here, whatever the corpus; cells above 16 million keep 24 bits.
    """
    shared = train.sparkSession.sparkContext.broadcast(model)
    size = FIRST_CLASS + int(model.word.max(initial=-1)) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, rows = shared.value, [], 0
        classes = own.classes()

        def out() -> pa.RecordBatch:
            key, n = (np.concatenate(x) for x in zip(*held))
            unique, inverse = np.unique(key, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(unique), pa.array(np.bincount(inverse, n).astype(np.int64))], ["pair", "n"])

        for part in slices(batches, "codes", SLICE):
            code, place, _, at, _ = sequence(own, classes, part)
            rank, spot = own.word[place[place >= 0]], at[place >= 0]
            code[spot[rank >= 0]] = FIRST_CLASS + rank[rank >= 0]
            held.append(np.unique((np.concatenate([[END], code[:-1]]) * size + code).astype(np.int32), return_counts=True))
            rows += len(held[-1][0])
            if rows > 2_000_000:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [zlib.compress(batch.column(c).to_numpy().tobytes(), 1) for c in ("pair", "n")]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], ["pair", "n"])

    counts = train.mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    whole = np.zeros(size * size, np.float32)
    for r in counts.mapInArrow(pack, "pair binary, n binary").collect():
        whole[np.frombuffer(zlib.decompress(r.pair), np.int32)] = np.frombuffer(zlib.decompress(r.n), np.int64)
    shared.unpersist()
    return whole.reshape(size, size)


def exchange(assigned: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each clustered word, and the counts of class pairs.

    Each word in turn moves to the class where the likelihood of the class bigrams is
    greatest; ``counts`` are those of ``word_pairs``. Every move renews the counts of classes
    around all other words, so no move lowers the likelihood. In the first round words
    enter one by one: the most frequent have a class each, and a later word joins a class by
    its counts with those before it; from classes that are all alike no single move leads away. ``assigned`` stays for ranks without a word.
    """

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    words = len(counts) - FIRST_CLASS
    of = np.concatenate([np.arange(FIRST_CLASS), np.full(words, -1)])
    # by class and word: counts of the class before the word, and of the class after it
    before, after, m = np.zeros((width, len(of))), np.zeros((width, len(of))), np.zeros((width, width))
    before[:FIRST_CLASS], after[:FIRST_CLASS] = counts[:FIRST_CLASS], counts[:, :FIRST_CLASS].T
    m[:FIRST_CLASS, :FIRST_CLASS] = counts[:FIRST_CLASS, :FIRST_CLASS]
    logs, targets = f(m), slice(FIRST_CLASS, None)
    inner = np.arange(FIRST_CLASS, width)
    for _ in range(ROUNDS):
        moves = 0
        for code in range(FIRST_CLASS, len(of)):
            old, itself = of[code], float(counts[code, code])
            into, outof = before[:, code].copy(), after[:, code].copy()
            if old >= 0:
                into[old] -= itself
                outof[old] -= itself
                m[:, old] -= into
                m[old, :] -= outof
                m[old, old] -= itself
                logs[:, old], logs[old, :] = f(m[:, old]), f(m[old, :])
            n, k = into.sum() + itself, outof.sum() + itself
            some, other = np.flatnonzero(into), np.flatnonzero(outof)
            gain = (f(m[some, targets] + into[some, None]) - logs[some, targets]).sum(axis=0)
            gain += (f(m[targets, other] + outof[None, other]) - logs[targets, other]).sum(axis=1)
            # a class's pairs with itself gain from both sides and by the word's pairs with itself
            own, x, y = m[inner, inner], into[targets], outof[targets]
            gain += f(own + x + y + itself) + f(own) - f(own + x) - f(own + y)
            # totals of the other words, their pairs with this one included
            cols, rows = (m.sum(axis=0) + outof)[targets], (m.sum(axis=1) + into)[targets]
            gain -= f(cols + n) - f(cols) + f(rows + k) - f(rows)
            new = code if old < 0 and code < width else FIRST_CLASS + int(np.argmax(gain))
            m[:, new] += into
            m[new, :] += outof
            m[new, new] += itself
            logs[:, new], logs[new, :] = f(m[:, new]), f(m[new, :])
            if new != old:
                of[code] = new
                moves += 1
                follows, leads = counts[code], counts[:, code]
                before[new] += follows
                after[new] += leads
                if old >= 0:
                    before[old] -= follows
                    after[old] -= leads
        if moves * SETTLED < words:
            break
    return np.concatenate([of[FIRST_CLASS:], assigned[words:]]), np.rint(m).astype(np.int64)


def seed(vocabulary: DataFrame, ends: int) -> Model:
    """The model before any exchange: the held words, and a class for each clustered one in turn. ``ends`` training texts."""
    sums = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(vocabulary, HELD, part="h").select("h", "e", "n").toArrow().sort_by([("n", "descending"), ("h", "ascending")])
    h, e, n = (top.column(c).to_numpy() for c in ("h", "e", "n"))
    order = np.argsort(h.view(np.uint64))
    word = np.where(np.arange(len(h)) < CLUSTERED, np.arange(len(h)), -1)[order]
    classes = class_number(int(sums[1]))
    assigned = FIRST_CLASS + np.arange(CLUSTERED) % classes
    return Model(h.view(np.uint64)[order], n[order], word, e[order], assigned, FIRST_CLASS + classes, int(sums[0]) + ends, int(sums[1]) + (ends > 0), ends)


def fit(train: DataFrame, model: Model, vocabulary: DataFrame) -> Model:
    """The model of the encoded texts ``train``, whose ``vocabulary`` (h, e, n) covers all their words, from a ``seed``.

    All counts are over all training texts, in one pass; only the number of words that are
    clustered and held is bounded.
    """
    assigned, pairs = exchange(model.assigned, word_pairs(train, model), model.width)
    model = replace(model, assigned=assigned)

    # words per class: the clustered by rank, all others by their ending
    others = vocabulary.groupBy(F.expr(f"e % {ENDINGS}").alias("ending")).agg(F.count("*").alias("words")).collect()
    words = np.zeros(model.width)
    for row in others:
        words[FIRST_ENDING + row.ending] += row.words
    known = model.word >= 0
    np.subtract.at(words, FIRST_ENDING + model.endings[known].astype(np.int64) % ENDINGS, 1)
    np.add.at(words, model.assigned[model.word[known]], 1)
    words[END] = 1
    words[FIRST_ENDING:FIRST_CLASS] += 1  # one more for words that training lacks

    return with_probabilities(model, pairs, words)


def with_probabilities(model: Model, pairs: np.ndarray, words: np.ndarray) -> Model:
    """The model with the probabilities that follow from the class pairs and the words of each class."""
    own = pairs.sum(axis=0).astype(np.float64)
    frequency = (own + 1) / (own.sum() + len(own))
    transition = np.log10((pairs + BACK * frequency[None, :]) / (pairs.sum(axis=1)[:, None] + BACK))
    below = np.log10(np.maximum(own + ADD * words, ADD))
    return replace(model, transition=transition, below=below, pairs=pairs)


def neighbours(train: DataFrame, shared) -> DataFrame:
    """(h, around): for every word that isn't clustered, its pairs of classes before and after it, each as count * width^2 + before * width + after."""

    width = shared.value.width

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        classes = own.classes()
        for part in slices(batches, "codes", SLICE):
            cls, place, h, at, _ = sequence(own, classes, part)
            free = place < 0
            free[~free] = own.word[place[~free]] < 0
            spot = at[free]
            key = np.where(spot > 0, cls[spot - 1], END) * width + cls[spot + 1]
            yield pa.RecordBatch.from_arrays([pa.array(h[free].view(np.int64)), pa.array(key.astype(np.int32))], ["h", "key"])

    # summed by word and pair first, in tasks and between them: a word has width^2 rows at most when they are gathered, however often it occurs
    counts = train.mapInArrow(find, "h bigint, key int").groupBy("h", "key").agg(F.count("*").alias("n"))
    return counts.groupBy("h").agg(F.collect_list(F.col("n") * F.lit(width * width) + F.col("key")).alias("around"))


class Gains:
    """For words with given counts around them, the class that raises the likelihood of the class bigrams most."""

    SMALL = 8  # counts up to this are looked up

    def __init__(self, pairs: np.ndarray):
        m = pairs.astype(np.float64)
        targets, self.width = slice(FIRST_CLASS, None), len(pairs)
        self.near = np.concatenate([m[:, targets], m[targets, :].T])  # by side * width + class
        self.rows, self.cols = m.sum(axis=1)[targets], m.sum(axis=0)[targets]
        # words are scored apart, and all rare ones would take an empty class for themselves
        self.barred = np.where((self.rows + self.cols == 0) & (self.rows + self.cols).any(), np.inf, 0)
        self.table = np.stack([self.more(self.near, n) for n in range(1, self.SMALL + 1)])

    @staticmethod
    def more(x: np.ndarray, n) -> np.ndarray:
        return (x + n) * np.log(x + n) - x * np.log(np.maximum(x, 1))

    def best(self, key: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The class of each word; its counts are those from its start to the next."""
        gain = self.table[np.minimum(n, self.SMALL) - 1, key]
        big = np.flatnonzero(n > self.SMALL)
        gain[big] = self.more(self.near[key[big]], n[big, None])
        total = np.add.reduceat(gain, starts, axis=0)
        times = np.add.reduceat(np.where(key < self.width, n, 0), starts)[:, None]
        return FIRST_CLASS + np.argmax(total - self.more(self.rows, times) - self.more(self.cols, times) - self.barred, axis=1)


def assign(train: DataFrame, model: Model, path: str) -> DataFrame:
    """(h, cls), written to ``path``: a class for every training word that isn't clustered.

    Each word goes where the likelihood of the class bigrams gains most, by its
    own counts against those of the fitted model; words are scored apart.
    """
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(model)
    width = model.width
    step = max((1 << 22) // (2 * width * width), 1)  # words at a time, of 2 width counts each at most, with a gain for every class

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(shared.value.pairs)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                around = part.column("around")
                code = around.flatten().to_numpy(zero_copy_only=False)
                word = np.repeat(np.arange(part.num_rows), around.value_lengths().to_numpy(zero_copy_only=False))
                n, key = np.divmod(code, width * width)
                cells = np.concatenate([word * (2 * width) + key // width, word * (2 * width) + width + key % width])
                sums = np.bincount(cells, np.concatenate([n, n]), part.num_rows * 2 * width).astype(np.int64)
                some = np.flatnonzero(sums)
                starts = np.searchsorted(some, np.arange(part.num_rows) * (2 * width))
                cls = gains.best(some % (2 * width), sums[some], starts)
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(cls.astype(np.int32))], ["h", "cls"])

    neighbours(train, shared).mapInArrow(choose, "h bigint, cls int").write.parquet(path)
    return spark.read.parquet(path)


def widen(model: Model, assigned: DataFrame) -> Model:
    """The model with the classes of all held words, and of words that training lacks by their ending.

    An ending goes to the class that gains most by the counts of all its words.
    """
    shared = assigned.sparkSession.sparkContext.broadcast(model.hashes)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for batch in batches:
            found = lookup.find(batch.column("h").to_numpy().view(np.uint64)) >= 0
            yield batch.filter(pa.array(found))

    some = assigned.mapInArrow(held, "h bigint, cls int").toArrow()
    every = model.classes().copy()
    every[np.searchsorted(model.hashes, some.column("h").to_numpy().view(np.uint64))] = some.column("cls").to_numpy()
    gains, unseen = Gains(model.pairs), np.full(ENDINGS, FIRST_CLASS)
    for i in range(ENDINGS):
        n = np.concatenate([model.pairs[:, FIRST_ENDING + i], model.pairs[FIRST_ENDING + i, :]])
        key = np.flatnonzero(n)
        if len(key):
            unseen[i] = gains.best(key, n[key], np.zeros(1, np.int64))[0]
    return replace(model, every=every, unseen=unseen)


def typed(encoded: DataFrame, model: Model, vocabulary: DataFrame, path: str) -> DataFrame:
    """(carried columns, n_tokens, n_known, base_score, words, cls) for every encoded text, written to ``path``.

    ``words`` is the sum of the logs of the counts, ``cls`` has the class of every
    token and of the end as 16-bit numbers. A task knows the ``HELD`` words; a
    text's other words are joined with the ``vocabulary`` (h, n, cls) by their
    hash, once per text and word.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)
    width = model.width
    names = [c for c in encoded.columns if c not in ("codes", "rest")]
    fields = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in names)
    numbers = "n_tokens bigint, n_known bigint, base_score double, words double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        classes = own.classes()
        logs = np.log10(own.counts + ADD)
        ends = np.log10(own.ends + ADD)
        base_below = math.log10(own.tokens + ADD * (own.distinct + 1))
        for part in slices(batches, "codes", SLICE):
            cls, place, h, at, sizes = sequence(own, classes, part)
            rows = len(sizes)
            text_of = np.repeat(np.arange(rows), sizes)
            found = place >= 0
            word_logs = np.zeros(len(cls))
            word_logs[at[found]] = logs[place[found]]
            words = np.bincount(text_of, word_logs, rows)
            known = np.bincount(text_of[at[found]], minlength=rows) + int(own.ends > 0)
            ending = cls[at[~found]] - FIRST_ENDING
            owner, rest = text_of[at[~found]], h[~found]
            order = np.lexsort((rest, owner))
            by_text, by_word = owner[order], rest[order]
            first = np.concatenate([[True], (by_word[1:] != by_word[:-1]) | (by_text[1:] != by_text[:-1])]) if len(rest) else np.zeros(0, bool)
            new = np.flatnonzero(first)
            times = np.diff(np.concatenate([new, [len(rest)]]))
            per_text = np.bincount(by_text[new], minlength=rows)
            cuts = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
            # a token of another word has -1 - its place in the text's list of them
            spot = np.empty(len(rest), np.int64)
            spot[order] = np.cumsum(first) - 1
            tokens = cls.astype(np.int32)
            tokens[at[~found]] = -1 - (spot - cuts[owner])
            edges = np.concatenate([[0], np.cumsum(sizes)])
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in names], pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)),
                    pa.array(words + ends - sizes * base_below), pa.array(words),
                    pa.array([tokens[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary()),
                    lists(by_word[new].view(np.int64), pa.int64()), lists(times, pa.int32()), lists(ending[order][new], pa.int32()),
                ],
                [*names, "n_tokens", "n_known", "base_score", "words", "tokens", "rest", "times", "endings"],
            )

    partly = encoded.mapInArrow(run, f"{fields}, {numbers}, tokens binary, rest array<bigint>, times array<int>, endings array<int>")
    partly.withColumn("rid", F.monotonically_increasing_id()).write.parquet(f"{path}/held")
    rows = spark.read.parquet(f"{path}/held")
    rest = rows.select("rid", F.posexplode(F.arrays_zip("rest", "times", "endings")).alias("i", "w"))
    rest = rest.select("rid", "i", F.col("w.rest").alias("h"), F.col("w.times").alias("k"), F.col("w.endings").alias("e"))
    unseen = F.get(F.array(*[F.lit(int(c)) for c in model.unseen]), F.col("e"))
    sums = rest.join(vocabulary, "h", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"),
        F.collect_list(F.col("i").cast("bigint") * F.lit(width) + F.coalesce("cls", unseen)).alias("own"),
    )
    whole = rows.drop("rest", "times", "endings").join(sums, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0))
    whole = whole.select(*names, "n_tokens", known.alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("words") + more).alias("words"), "tokens", "own")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "tokens"):
            done = []
            own, sizes = part.column("own").flatten().to_numpy(zero_copy_only=False), part.column("own").value_lengths().fill_null(0).to_pylist()
            start = 0
            for data, size in zip(part.column("tokens").to_pylist(), sizes):
                tokens = np.frombuffer(data, np.int32)
                if size:
                    code = own[start : start + size]
                    classes = np.empty(size, np.int32)
                    classes[code // width] = code % width
                    tokens = np.where(tokens < 0, classes[np.maximum(-1 - tokens, 0)], tokens)
                    start += size
                done.append(tokens.astype(np.int16).tobytes())
            kept = [part.column(c) for c in (*names, "n_tokens", "n_known", "base_score", "words")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(done, pa.binary())], [*names, "n_tokens", "n_known", "base_score", "words", "cls"])

    whole.mapInArrow(fill, f"{fields}, {numbers}, cls binary").write.parquet(f"{path}/all")
    return spark.read.parquet(f"{path}/all")


def pair_counts(rows: DataFrame, width: int) -> np.ndarray:
    """Counts of pairs of the ``width`` classes in ``cls``; a task sends one array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(width * width, np.int64)
        for part in slices(batches, "cls"):
            cls = np.frombuffer(b"".join(part.column("cls").to_pylist()), np.int16).astype(np.int64)
            pairs += np.bincount(np.concatenate([[END], cls[:-1]]) * width + cls, minlength=width * width)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(pairs[some])], ["pair", "n"])

    out = np.zeros(width * width, np.int64)
    for r in rows.select("cls").mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(width, width)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """The rows of ``typed`` with ``score`` for their classes."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c not in ("words", "cls")]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        below = own.below.copy()
        below[END] = 0
        for part in slices(batches, "cls"):
            cls = np.frombuffer(b"".join(part.column("cls").to_pylist()), np.int16).astype(np.int64)
            text_of = np.repeat(np.arange(part.num_rows), part.column("n_tokens").to_numpy())
            logs = own.transition[np.concatenate([[END], cls[:-1]]), cls] - below[cls]
            total = np.bincount(text_of, logs, part.num_rows) + part.column("words").to_numpy()
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(total)], [*names, "score"])

    return rows.mapInArrow(run, f"{fields}, score double").withColumnsRenamed({c: c[1:] for c in names if c.startswith("_")})


def lm_table(rows: DataFrame, vocabulary: DataFrame, path: str) -> tuple[DataFrame, Model, DataFrame]:
    """``typed`` rows of ``rows`` (doc_id, text, held_out), the model in which every training word has a class, and (h, n, cls) of the words that aren't clustered.

    Texts are cut into words and looked up once; all further passes read their codes.
    """
    spark = rows.sparkSession
    start = seed(vocabulary, rows.where(~F.col("held_out")).count())
    carried = rows.select(F.col("doc_id").alias("_doc_id"), F.col("held_out").alias("_held_out"), "text")
    encoded = encode(carried, start, f"{path}/encoded")
    train = encoded.where(~F.col("_held_out")).select("codes", "rest")
    fitted = fit(train, start, vocabulary)
    assigned = assign(train, fitted, f"{path}/assigned")
    model = widen(fitted, assigned)
    vocabulary.select("h", "n").join(assigned, "h").write.parquet(f"{path}/words")
    others = spark.read.parquet(f"{path}/words")
    table = typed(encoded, model, others, f"{path}/typed")
    words = np.zeros(model.width)
    for r in others.groupBy("cls").agg(F.count("*").alias("words")).collect():
        words[r.cls] += r.words
    np.add.at(words, model.assigned[model.word[model.word >= 0]], 1)
    words[END] = 1
    np.add.at(words, model.unseen, 1)  # one more per ending for words that training lacks
    return table, with_probabilities(model, pair_counts(table.where(~F.col("_held_out")), model.width), words), others


def lm_rows(documents: DataFrame) -> DataFrame:
    """Fits on the documents that are not held out and scores all of them.

    Scores are sums of log10 over the words of the whole text and its end. A null or
    empty text has the end only; equal rows have equal scores; without training
    documents every count is 0 and scores are still finite.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), is_held_out("doc_id").alias("held_out"))
    train = rows.where(~F.col("held_out")).select("text")
    path = scratch_path(spark, "vocabulary")
    count_words(train).write.parquet(path)
    vocabulary = spark.read.parquet(path)
    table, model, _ = lm_table(rows, vocabulary, scratch_path(spark, "class-lm"))
    scored = score(table, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
