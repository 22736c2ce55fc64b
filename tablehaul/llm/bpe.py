"""Byte-level BPE through a compiled lexicon of frequent words."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablehaul.llm.arrow import slices
from tablehaul.llm.frequent import most_frequent
from tablehaul.llm.lexicon import Lexicon, compile_lexicon
from tablehaul.session import scratch_path

#: Words in the lexicon at most; all others are merged one by one, with the same ids.
LEXICON_WORDS = 65_536
#: Words a worker remembers before it forgets them all and starts anew.
REMEMBERED = 400_000
#: Fixed value: how the tokenizer cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 48
#: Words of more bytes are in no lexicon and are not remembered, so memory is bounded; they are merged each time.
LONGEST = 64
MASK, NONE = (1 << 32) - 1, 1 << 62


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file; a few MB, whatever the corpus."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs, ids = byte_signs(), spec["model"]["vocab"]
        self.tokens = {i: bytes(signs[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: content.encode() for content, i in self.special.items()}
        self.byte_ids = [0] * 256
        for token, i in ids.items():
            if len(token) == 1:
                self.byte_ids[signs[token]] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # pair of ids -> rank and new id in one number, so that the smallest number is the next merge
        self.merges = {ids[a] << 32 | ids[b]: rank << 32 | ids[a + b] for rank, (a, b) in enumerate(pairs)}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank is merged first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        find = self.merges.get
        codes = [find(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while codes:
            best = min(codes)
            if best == NONE:
                break
            i = codes.index(best)
            ids[i] = best & MASK
            del ids[i + 1], codes[i]
            if i < len(codes):
                codes[i] = find(ids[i] << 32 | ids[i + 1], NONE)
            if i:
                codes[i - 1] = find(ids[i - 1] << 32 | ids[i], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours: n log n for a word without white space."""
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            found = self.merges.get(ids[i] << 32 | ids[j]) if j >= 0 else None
            if found is not None:
                heapq.heappush(heap, (found, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            code, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = code & MASK, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [t for t, ok in zip(ids, alive) if ok]


def _segments(special: dict[str, int]):
    """A pattern that cuts a text at the special tokens, or None without any."""
    return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None


def count_words(df: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each word follows a space in all texts.

    A word reaches from a space to the next one, punctuation and line ends
    included. Words that are empty or start with white space are left out: the
    tokenizer doesn't cut before their space. Words of over ``LONGEST`` bytes are left out as well.
    """
    rows = df.select(F.explode(F.slice(F.split(F.col(text), " ", -1), 2, (1 << 31) - 1)).alias("word")).where(F.octet_length("word") <= LONGEST)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col("word").rlike(r"^\S"))


def _ship(spark: SparkSession, flat: np.ndarray) -> str:
    """Write the lexicon below the shared scratch folder and have every executor fetch it; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'lexicon')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(flat.astype("<i4").tobytes())
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def build_lexicon(df: DataFrame, text: str, vocabulary: Vocabulary, size: int) -> str:
    """Compile the most frequent words of the whole corpus, ``size`` at most, and ship them."""
    path = scratch_path(df.sparkSession, "word-counts")
    count_words(df, text).write.parquet(path)
    top = most_frequent(df.sparkSession.read.parquet(path), size)
    find = regex.compile(PATTERN).findall
    entries = []
    for row in top.collect():
        spaced = " " + row.word
        entries.append((spaced.encode(), [i for piece in find(spaced) for i in vocabulary.merge(piece.encode())]))
    return _ship(df.sparkSession, compile_lexicon(sorted(entries)))


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    return Lexicon(np.memmap(SparkFiles.get(name), dtype="<i4", mode="r"))


class Encoder:
    """Texts to ids in one task.

    The tokenizer always cuts before a space that something else than white space
    follows, so a text can be split at its spaces and each word looked up with its
    space. Texts with other spaces are cut by the tokenizer's own pattern.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.find = regex.compile(PATTERN).findall
        self.white = regex.compile(r"\s").match
        self.cut = _segments(vocabulary.special)
        self.known: dict[str, bytes] = {}  # word, without the space before it
        self.pieces: dict[str, bytes] = {}
        table = [vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens) + 1)]
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.table = np.frombuffer(b"".join(table), np.uint8)

    def plain(self, text: str) -> bytes:
        """By the tokenizer's pattern, each piece merged."""
        out = []
        for piece in self.find(text):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = np.array(self.vocabulary.merge(piece.encode()), "<u4").tobytes()
                if len(piece) <= LONGEST:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words: from the lexicon, or merged if it lacks them."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        todo = [w for w in words if w not in self.known and w and len(w) <= LONGEST and not self.white(w)]
        spaced = [" " + w for w in todo]
        for word, full, ids in zip(todo, spaced, self.lexicon.find([x.encode() for x in spaced])):
            self.known[word] = self.plain(full) if ids is None else ids

    def after_space(self, word: str) -> bytes:
        """The ids of a word and the space before it; KeyError where the tokenizer doesn't cut before that space."""
        if len(word) > LONGEST and not self.white(word):
            return self.plain(" " + word)
        return self.known[word]

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [text.split(" ") for text in texts]
        self.learn(set().union(*split))
        out = []
        for text, words in zip(texts, split):
            if any(s in text for s in self.vocabulary.special):
                parts = self.cut.split(text)
                out.append(b"".join(np.array([self.vocabulary.special[x]], "<u4").tobytes() if i % 2 else self.plain(x) for i, x in enumerate(parts)))
                continue
            try:
                out.append(self.plain(words[0]) + b"".join(map(self.after_space, words[1:])))
            except KeyError:  # white space beside a space
                out.append(self.plain(text))
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of id sequences: bytes of all tokens, broken UTF-8 replaced."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        raw = self.table[places].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) // 4 for x in ids)])]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def encode(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), tokenizer: str | None = None, size: int = LEXICON_WORDS) -> DataFrame:
    """The columns ``keep``, ids and decoded for every row: ids as little-endian unsigned 32-bit integers, and the text they decode to.

    Two passes: the first counts words for the lexicon, the second splits each
    whole text into words and takes their ids from the memory-mapped lexicon or, if
    it lacks a word, from merging it. Special tokens in a text get their own ids. A
    null text counts as empty and has no ids; equal rows get equal results; an empty table gives no rows. Texts
    are never shuffled, and a task works on a few MB of them at a time.
    """
    spark = df.sparkSession
    own = Vocabulary(tokenizer or default_tokenizer())
    name = build_lexicon(df, text, own, size)
    vocabulary = spark.sparkContext.broadcast(own)
    narrow = df.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, _mapped(name))
        for part in slices(batches, "text"):
            ids = encoder.ids([value or "" for value in part.column("text").to_pylist()])
            decoded = encoder.decode(ids)
            yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["kept", "ids", "decoded"])

    schema = T.StructType([narrow.schema["kept"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return narrow.mapInArrow(run, schema).select(*[F.col("kept")[c].alias(c) for c in keep], "ids", "decoded")


def _digests() -> list[Column]:
    return [F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")]


def encode_rows(documents: DataFrame) -> DataFrame:
    """doc_id, the number of tokens, digests of the ids and of the decoded text."""
    return encode(documents).select("doc_id", *_digests())


def encode_corpus(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, the ids that stand for it, their number and both digests."""
    others = [c for c in documents.columns if c != text]
    return encode(documents, text, others).select(*[F.col(c) for c in others], "ids", *_digests())
