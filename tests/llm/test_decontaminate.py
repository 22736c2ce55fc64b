import random

import pytest

from tablehaul.llm import decontaminate
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def wanted(docs, items):
    out = []
    size = lambda t: min(5, len(brute.WORD.findall(t or "")))
    own = [(i, brute.shingles(t, size(t), short=False), size(t)) for i, t in items if size(t)]
    for d, text in docs:
        have = {n: brute.shingles(text, n, short=False) for n in {n for *_, n in own}}
        out += [(d, i, len(s & have[n]), len(s)) for i, s, n in own if s and 100 * len(s & have[n]) >= 80 * len(s)]
    return out


def found(docs, benchmark):
    return sorted(tuple(r) for r in decontaminate.find_items(docs, benchmark).collect())


def test_documents(spark, documents, texts):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = wanted(texts.items(), [(r.item_id, r.text) for r in benchmark.collect()])
    assert want and found(documents, benchmark) == sorted(want)
    clean = decontaminate.drop_contaminated(documents, benchmark)
    assert clean.columns == documents.columns
    assert {r.doc_id for r in clean.collect()} == set(texts) - {d for d, *_ in want}


def planted(seed=1):
    """Items of all sizes, in whole, in part, in pieces and scattered, in long documents."""
    pick = random.Random(seed)
    word = lambda: f"w{pick.randrange(30_000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 7, 9, 13, 20, 33, 60, 130, 300, 1, 4])]
    docs = []
    for i, text in items:
        words = text.split()
        for cut in (0, 1, 2, 5, 10):
            part = words[: len(words) - cut]
            half = len(part) // 2
            for n in (10, 400, 6000):
                noise = [word() for _ in range(n)]
                docs.append((len(docs), " ".join([*noise[: n // 2], *part, *noise[n // 2 :]]).upper()))
                docs.append((len(docs), "\n".join([*part[half:], *noise, *part[: half + 4]])))
    return docs, items


def test_planted(spark):
    docs, items = planted()
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    want = sorted(wanted(docs, items))
    assert got == want and len(want) > 60


def test_short_items_are_found_by_their_words(spark):
    items = spark.createDataFrame([(1, "the capital is paris"), (2, "Paris"), (3, "is the"), (4, "x y z")], "item_id long, text string")
    docs = [(1, "we know the\nCapital is  PARIS now"), (2, "parisian is\tthe"), (3, "the capital is"), (4, "x y"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, items) == [(1, 1, 1, 1), (1, 2, 1, 1), (2, 3, 1, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, items).collect()) == [3, 4, 5]


def test_equal_items_are_searched_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 300)
    items = spark.createDataFrame([(7, "one two three four five six")] * 1000 + [(i, f"a{i} b c d e f g") for i in range(60)], "item_id long, text string")
    sizes = [len(rows) for rows in decontaminate.item_blocks(items, "item_id", "text")]
    assert sum(sizes) == 61 and max(sizes) <= 25
    assert found(spark.createDataFrame([(1, "zero one two three four five six")], "doc_id long, text string"), items) == [(1, 7, 2, 2)] * 1000


def test_items_in_blocks(spark, monkeypatch):
    docs, items = planted()
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 1000)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(d, b) == sorted(wanted(docs, items))
    hit = {x for x, *_ in wanted(docs, items)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {i for i, _ in docs} - hit


def test_odd_empty_and_clashing(spark, odd, empty, clashing):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "a null id has a text of its own here"), (3, "word"), (4, "a null id has a text of its own here")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.find_items(odd, items).collect()), key=str)
    want = wanted([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == sorted(want, key=str) and (4, 3, 1, 1) in got
    twice = sorted(map(tuple, decontaminate.find_items(odd, items.unionAll(items)).collect()), key=str)
    assert twice == sorted(want * 2, key=str)
    assert found(odd, items.limit(0)) == [] and found(empty, items) == []
    out = decontaminate.drop_contaminated(clashing, items)
    assert out.columns == clashing.columns and out.count() == 4


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_miss_probability_sets_the_hash_functions(percent):
    n = decontaminate.hash_functions(percent, 1e-8)
    assert (1 - percent / 300) ** n <= 1e-8 < (1 - percent / 300) ** (n - 1)
