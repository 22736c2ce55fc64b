import hashlib
import random
import struct

import numpy as np
import pytest

from tablehaul.llm import bpe
from tablehaul.llm.lexicon import Lexicon, compile_lexicon

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_tokenizer())


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def got(df):
    return sorted(((r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in bpe.encode_rows(df).collect()), key=str)


def test_documents(documents, texts, library):
    assert got(documents) == sorted([(k, want(library, t)) for k, t in texts.items()], key=str)


def test_all_signs_and_spaces(spark, library):
    pick = random.Random(2)
    parts = [" ", "  ", "\n", "\t", " ", " ", "\u0085", "\x1c", "a", "Word", "it's", "I'LL", "'re", "12", "½", "²", "日本", "🎉", "é", "é", "...", "<|endoftext|>", "<|", "_", "-"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(chr(c) for c in range(a, a + 500) if not 0xD800 <= c < 0xE000) for a in range(1, 0x3000, 500)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == sorted([(i, want(library, t)) for i, t in rows], key=str)


def test_odd_empty_and_clashing(odd, empty, clashing, library):
    assert got(odd) == sorted([(r.doc_id, want(library, r.text)) for r in odd.collect()], key=str)
    assert got(empty) == []
    assert len(got(clashing)) == 4


def test_a_small_lexicon_changes_nothing(documents, texts, library):
    for size in (0, 3):
        rows = bpe.encode(documents, size=size).collect()
        assert {r.doc_id: hashlib.sha256(r.ids).hexdigest() for r in rows} == {k: want(library, t)[1] for k, t in texts.items()}
        assert {r.doc_id: r.decoded for r in rows} == texts


def test_long_words_take_the_heap(library):
    vocabulary = bpe.Vocabulary(bpe.default_tokenizer())
    pick = random.Random(5)
    for n in (10, 49, 200, 3000):
        word = "".join(pick.choice("abcdefghijklmnop") for _ in range(n))
        assert vocabulary.merge(word.encode()) == library.encode(word, add_special_tokens=False).ids
    assert vocabulary.merge(b"z" * 100_000) == library.encode("z" * 100_000, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact():
    words = sorted({f"{a}{b}{c}".encode() for a in ("un", "re", "", "pre") for b in ("do", "make", "think") for c in ("", "s", "ing", "ings")})
    flat = compile_lexicon([(w, [i, i * 2][: 1 + i % 2]) for i, w in enumerate(words)])
    lexicon = Lexicon(flat)
    assert flat[0] < sum(map(len, words)) / 4  # shared suffixes
    for i, w in enumerate(words):
        assert np.frombuffer(lexicon.find([w])[0], "<u4").tolist() == [i, i * 2][: 1 + i % 2]
    assert lexicon.find([b"", b"x", b"undoi", b"unmakingss", b"u"]) == [None] * 5
    assert Lexicon(compile_lexicon([])).find([b"a"]) == [None]


def test_long_words_are_merged_and_not_remembered(spark, library):
    long = "日本語" * 400
    rows = [(i, f"a {long} b {long}x {'q' * 64} {'q' * 65} \n{long}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == sorted([(i, want(library, t)) for i, t in rows], key=str)
    words = {r.word for r in bpe.count_words(df, "text").collect()}
    assert words == {"b", "q" * 64}
    vocabulary = bpe.Vocabulary(bpe.default_tokenizer())
    encoder = bpe.Encoder(vocabulary, Lexicon(compile_lexicon([])))
    encoder.ids([t for _, t in rows])
    assert max(map(len, [*encoder.known, *encoder.pieces])) <= bpe.LONGEST


def test_corpus_keeps_the_other_columns(clashing, library):
    out = bpe.encode_corpus(clashing)
    others = [c for c in clashing.columns if c != "text"]
    assert out.columns == [*others, "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: len(r.ids) // 4 for r in out.collect()} == {r.doc_id: want(library, r.text)[0] for r in clashing.collect()}
