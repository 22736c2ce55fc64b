import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tablehaul.llm import brown_lm
from tests.llm import brute


def wanted(rows):
    count = Counter()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    for i, t in rows:
        if not held(i):
            count.update(brute.words(t))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        tokens = [*brute.words(t), None]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        out.append((i, held(i), len(tokens), sum(count[x] > 0 for x in tokens), n, base))
    return out


def check(df, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in brown_lm.lm_rows(df).collect()), key=str)
    want = sorted(wanted(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) for g, w in zip(got, want))


@pytest.fixture
def small(monkeypatch):
    """Few held words, so that the join has most of the work."""
    monkeypatch.setattr(brown_lm, "HELD", 300)
    monkeypatch.setattr(brown_lm, "ROUNDS", 2)


def test_documents(documents, texts, small):
    check(documents, list(texts.items()))


def test_held_out_text_is_less_surprising_than_to_single_words(spark, monkeypatch):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in brown_lm.lm_rows(documents).collect() if r.held_out]
    base, model = (sum(r[c] for r in held) / sum(r.n_tokens for r in held) for c in ("base_score", "score"))
    assert model > base + 0.1


def test_probabilities_sum_to_one(documents, small, tmp_path):
    train = documents.select("text")
    vocabulary = brown_lm.count_words(train).cache()
    start = brown_lm.seed(vocabulary, train.count())
    model = brown_lm.fit(brown_lm.encode(train, start, str(tmp_path / "encoded")), start, vocabulary)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    mass = np.zeros(model.width)
    classes = dict(zip(model.hashes.view(np.int64).tolist(), model.classes().tolist()))
    for r in vocabulary.collect():
        cls = classes.get(r.h, brown_lm.FIRST_ENDING + r.e % brown_lm.ENDINGS)
        mass[cls] += (r.n + brown_lm.ADD) / 10 ** model.below[cls]
    ends = slice(brown_lm.FIRST_ENDING, brown_lm.FIRST_CLASS)
    mass[ends] += brown_lm.ADD / 10 ** model.below[ends]  # words that training lacks
    used = mass[1:] > 0
    assert np.allclose(mass[1:][used], 1)


def test_exchange_finds_classes():
    """Words of two kinds that follow each other in turn end up in classes of one kind each."""
    pick = np.random.default_rng(3)
    words = 40
    assigned = brown_lm.FIRST_CLASS + np.arange(words) % 2
    kind = (np.arange(words) >= words // 2).astype(int)
    seq = np.array([pick.integers(0, words // 2) + (i % 2) * (words // 2) for i in range(40_000)])
    counts = np.zeros((brown_lm.FIRST_CLASS + words,) * 2, np.float32)
    np.add.at(counts, (brown_lm.FIRST_CLASS + seq[:-1], brown_lm.FIRST_CLASS + seq[1:]), 1)
    assigned, _ = brown_lm.exchange(assigned, counts, brown_lm.FIRST_CLASS + brown_lm.CLASSES)
    assert not set(assigned[kind == 0]) & set(assigned[kind == 1])


def likelihood(counts, of, width):
    pairs = np.zeros((width, width), np.int64)
    np.add.at(pairs, (of[:, None], of[None, :]), counts.astype(np.int64))
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return pairs, f(pairs) - f(pairs.sum(axis=0)) - f(pairs.sum(axis=1))


def test_no_round_of_the_exchange_lowers_the_likelihood(monkeypatch):
    """Words that also follow themselves; pairs counted anew from the classes agree with those kept up to date."""
    pick, words, fixed = np.random.default_rng(8), 60, brown_lm.FIRST_CLASS
    counts = (pick.poisson(0.4, (fixed + words,) * 2) * pick.integers(1, 9, (fixed + words, 1))).astype(np.float32)
    width, start = fixed + 7, fixed + np.arange(words) % 7
    last = likelihood(counts, np.concatenate([np.arange(fixed), start]), width)[1]
    for rounds in range(1, 6):
        monkeypatch.setattr(brown_lm, "ROUNDS", rounds)
        assigned, pairs = brown_lm.exchange(start, counts, width)
        want, now = likelihood(counts, np.concatenate([np.arange(fixed), assigned]), width)
        assert (pairs == want).all() and now >= last - 1e-6
        last = now
    moved = lambda w, c: likelihood(counts, np.concatenate([np.arange(fixed), np.where(np.arange(words) == w, c, assigned)]), width)[1]
    monkeypatch.setattr(brown_lm, "SETTLED", 10**9)  # until no word moves: then no single move is better
    monkeypatch.setattr(brown_lm, "ROUNDS", 100)
    assigned, _ = brown_lm.exchange(start, counts, width)
    best = moved(0, assigned[0])
    assert all(moved(w, c) <= best + 1e-6 for w in range(words) for c in range(fixed, width))


def test_odd_empty_and_clashing(odd, empty, clashing, small):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(odd, rows)
    assert all(math.isfinite(r.score) for r in brown_lm.lm_rows(odd).collect())
    assert brown_lm.lm_rows(empty).count() == 0
    assert brown_lm.lm_rows(clashing).count() == 4


def test_small_slices_change_nothing(spark, documents, monkeypatch):
    want = {r.doc_id: r.score for r in brown_lm.lm_rows(documents).collect()}
    monkeypatch.setattr(brown_lm, "SLICE", 5000)
    got = {r.doc_id: r.score for r in brown_lm.lm_rows(documents.repartition(5)).collect()}
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want) and len(got) == len(want)


def test_classes_grow_with_the_vocabulary(spark, documents, small, monkeypatch, tmp_path):
    numbers = [brown_lm.class_number(10**k) for k in range(3, 13)]
    assert numbers == sorted(numbers) and numbers[0] == brown_lm.CLASSES and numbers[-1] == 2500
    train = documents.select("text")
    vocabulary = brown_lm.count_words(train).cache()
    monkeypatch.setattr(brown_lm, "PER_ROOT", 110 / vocabulary.count() ** 0.25)
    start = brown_lm.seed(vocabulary, train.count())
    assert start.width == brown_lm.FIRST_CLASS + 110
    check(documents, [(r.doc_id, r.text) for r in documents.collect()])
