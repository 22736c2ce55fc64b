"""Every training word has a class by its neighbours, not only the frequent ones."""

import numpy as np
import pytest

from tablehaul.llm import brown_lm
from tablehaul.llm.shingles import word_hashes


def table_of(spark, documents, path):
    rows = documents.selectExpr("doc_id", "coalesce(text, '') AS text").withColumn("held_out", brown_lm.is_held_out("doc_id"))
    train = rows.where("not held_out").select("text")
    vocabulary = brown_lm.count_words(train).cache()
    return (*brown_lm.lm_table(rows, vocabulary, str(path)), vocabulary)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(brown_lm, "HELD", 300)
    monkeypatch.setattr(brown_lm, "ROUNDS", 2)


def test_rare_words_join_the_class_of_their_kind(spark, tmp_path, monkeypatch):
    # words of two kinds take turns, END apart; rare ones of both kinds end in the same letters
    monkeypatch.setattr(brown_lm, "HELD", 40)
    pick = np.random.default_rng(5)
    kinds = [[f"{k}{i}x" for i in range(10)] for k in "ab"]
    rare = [[f"{k}{i}z" for i in range(60)] for k in "cd"]
    texts = []
    for doc in range(300):
        words = [kinds[i % 2][pick.integers(0, 10)] for i in range(100)]
        if doc < 240:  # each rare word four times
            words[40] = rare[0][doc % 60]
            words[71] = rare[1][doc % 60]
        texts.append((doc, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    _, model, others, _ = table_of(spark, df, tmp_path)
    cls = {r.h: r.cls for r in others.collect()}
    found = [{cls[h] for h in word_hashes([" ".join(r).encode()])[0].view(np.int64).tolist() if h in cls} for r in rare]
    assert found[0] and found[1] and not found[0] & found[1]
    own = [set(model.classes()[np.searchsorted(model.hashes, word_hashes([" ".join(k).encode()])[0])].tolist()) for k in kinds]
    assert found[0] <= own[0] and found[1] <= own[1]


def test_every_training_word_has_an_exchange_class_and_mass_is_one(spark, documents, small, tmp_path):
    table, model, others, vocabulary = table_of(spark, documents, tmp_path)
    cls = {r.h: r.cls for r in others.collect()} | dict(zip(model.hashes.view(np.int64).tolist(), model.classes().tolist()))
    mass = np.zeros(model.width)
    for r in vocabulary.collect():
        assert brown_lm.FIRST_CLASS <= cls[r.h] < model.width
        mass[cls[r.h]] += (r.n + brown_lm.ADD) / 10 ** model.below[cls[r.h]]
    for c in model.unseen:
        mass[c] += brown_lm.ADD / 10 ** model.below[c]
    used = mass[1:] > 0
    assert np.allclose(mass[1:][used], 1) and np.allclose((10**model.transition).sum(axis=1), 1)


@pytest.mark.parametrize("classes", [64, 100])
def test_scores_against_plain_python(spark, documents, small, tmp_path, monkeypatch, classes):
    monkeypatch.setattr(brown_lm, "CLASSES", classes)
    table, model, others, vocabulary = table_of(spark, documents, tmp_path)
    cls = {r.h: r.cls for r in others.collect()} | dict(zip(model.hashes.view(np.int64).tolist(), model.classes().tolist()))
    n = {r.h: r.n for r in vocabulary.collect()}
    pairs = np.zeros((model.width, model.width), int)
    want = {}
    for r in documents.collect():
        text = (r.text or "").encode()
        tokens = word_hashes([text])[0].view(np.int64).tolist()
        last = [w[-1] for w in text.split()]
        seq = [0, *(cls.get(h, model.unseen[e % brown_lm.ENDINGS]) for h, e in zip(tokens, last)), 0]
        logs = model.transition[seq[:-1], seq[1:]].sum()
        want[r.doc_id] = logs + sum(np.log10(n.get(h, 0) + brown_lm.ADD) - model.below[c] for h, c in zip(tokens, seq[1:]))
        want[r.doc_id, "seq"] = seq
    for r in table.where("not _held_out").collect():
        seq = want[r._doc_id, "seq"]
        np.add.at(pairs, (seq[:-1], seq[1:]), 1)
    assert (pairs == model.pairs).all()
    got = {r.doc_id: r.score for r in brown_lm.score(table, model).collect()}
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got) and len(got) == documents.count()


def test_flat_vocabulary_has_seeds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(brown_lm, "HELD", 50)
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(40)], "doc_id long, text string")
    _, model, others, vocabulary = table_of(spark, df, tmp_path)
    assert 0 < len(model.hashes) <= 50 and others.count() + len(model.hashes) == vocabulary.count()
