import random

from tablehaul.llm import quality
from tests.llm import brute


def rows_of(df):
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in quality.quality_rows(df).collect()]


def test_documents(documents, texts):
    assert dict(rows_of(documents)) == {k: brute.quality(t) for k, t in texts.items()}


def test_random_texts(spark):
    pick = random.Random(3)
    texts = {i: "".join(pick.choice(["a", "b", "c#", "dé"]) + pick.choice([" ", "\n", "\t\r", " \n\n "]) for _ in range(pick.randint(0, 40))) for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(rows_of(df)) == {k: brute.quality(t) for k, t in texts.items()}


def test_odd_rows(odd):
    key = lambda x: str(x)
    assert sorted(rows_of(odd), key=key) == sorted([(r.doc_id, brute.quality(r.text)) for r in odd.collect()], key=key)


def test_kept_needs_the_base_check(documents):
    rows = quality.quality_rows(documents).collect()
    assert not [r for r in rows if r.base_failed and r.kept]
    assert [r for r in rows if not r.base_failed and not r.kept]


def test_policies_use_the_stored_bits(documents):
    ledger = quality.measure(documents)
    bits = [r.quality.bits for r in ledger.collect()]
    policies = [quality.BASE, quality.DEFAULT, quality.Policy("symbols", 3, ("symbols",))]
    got = {(r.policy, r.rule): (r.version, r.failed, r.failed_alone, r.rejected) for r in quality.ablations(ledger, policies).collect()}
    for p in policies:
        for rule in p.rules:
            b = quality.bit(rule)
            want = (p.version, sum(bool(x & b) for x in bits), sum(x & p.mask == b for x in bits), sum(bool(x & p.mask) for x in bits))
            assert got[(p.name, rule)] == want


def test_empty_and_clashing(empty, clashing):
    assert quality.quality_rows(empty).count() == 0
    assert {r.failed for r in quality.ablations(quality.measure(empty), [quality.BASE]).collect()} == {0}
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns and [r.doc_id for r in kept.collect()] == [4]
