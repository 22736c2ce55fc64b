import random

import numpy as np
import pytest

from tablehaul.llm import near_dup
from tablehaul.llm.components import components
from tests.llm import brute


def groups(df, k=4):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_dup_rows(df, k, 80).collect()]


def wanted(rows, k=4):
    """By plain comparison of all sets."""
    texts = [t for _, t in rows]
    roots = brute.near_groups(texts, k)
    low = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            low[root] = min(low.get(root, i), i)
    return [(i, len(brute.shingles(t, k)), low.get(root), i == low.get(root)) for (i, t), root in zip(rows, roots)]


def test_documents(documents, texts):
    rows = sorted(texts.items())
    assert sorted(groups(documents)) == sorted(wanted(rows))


def near_copies(seed=5):
    """Groups of copies with more and more words changed, of all lengths."""
    pick = random.Random(seed)
    rows = []
    for size in (3, 4, 5, 6, 8, 12, 25, 60, 200):
        base = [f"g{size}w{i}" for i in range(size)]
        for copy in range(12):
            words = list(base)
            for _ in range(copy // 3):
                words[pick.randrange(size)] = f"new{pick.random()}"
            rows.append((len(rows), " ".join(words).upper() if copy % 2 else "\n".join(words)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_copies(spark, k):
    rows = near_copies()
    got = groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k)
    assert sorted(got) == sorted(wanted(rows, k))


def test_many_copies_make_no_pairs(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)] + [(300 + i, " ".join([*base, f"tail{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = groups(df)
    assert {c for *_, c, _ in got} == {0} and sum(k for *_, k in got) == 1


@pytest.mark.parametrize("small,side", [(16, 256), (2, 8), (1000, 256)])
def test_dense_bucket_that_hubs_do_not_join(spark, monkeypatch, small, side):
    """Texts that are linked along a chain only: every cut of the buckets gives the same groups."""
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "SIDE", side)
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(90)] + [(100 + i, " ".join(words[i * 40 : i * 40 + 60])) for i in range(9)]
    random.Random(8).shuffle(rows)
    got = groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(got) == sorted(wanted(rows))


def test_block_links_join_what_all_pairs_join():
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, 120, 2)]
    flat, sizes = near_dup.distinct_shingles(texts, 4)
    signatures = near_dup.block_minima(flat, np.cumsum(sizes) - sizes, near_dup.HASHES)
    v = np.arange(len(texts)) + 1000
    all_rows, half = np.arange(len(texts)), np.arange(len(texts)) < 30
    found = near_dup.block_links(v, v, signatures, texts, all_rows, all_rows, 0, 4, 80)
    assert len(found) == len(texts) - 1  # a tree
    between = near_dup.block_links(v, v, signatures, texts, all_rows[half], all_rows[~half], 0, 4, 80)
    assert between and all((a < 1030) != (b < 1030) for a, b in between)
    # a pair is left to the first band in which it agrees
    parts = {p for band in range(near_dup.BANDS) for p in near_dup.block_links(v, v, signatures, texts, all_rows[:2], all_rows[:2], band, 4, 80)}
    assert parts == {(1000, 1001)}


def test_posterior_bounds():
    """A pair of similarity 0.8 stays with all but a tiny chance, one of 0.3 hardly ever."""
    pick = np.random.default_rng(2)
    same = pick.random((20_000, near_dup.HASHES))
    zero = np.zeros(same.shape, np.uint8)
    assert len(near_dup.survivors(zero, (same >= 0.8).astype(np.uint8), 80)) >= 19_998
    assert len(near_dup.survivors(zero, (same >= 0.3).astype(np.uint8), 80)) == 0


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    key = lambda x: str(x)
    assert sorted(groups(odd), key=key) == sorted([(i, n, c, k if i is not None else c is None) for i, n, c, k in wanted(rows)], key=key)


def test_one_row_of_a_group_stays(spark, empty, clashing):
    rows = [(5, "the same text twice"), (5, "the same text twice"), (None, "the same text twice"), (7, ""), (8, None), (8, None)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text is not None) == [(5, "the same text twice"), (7, "")]
    assert [r.doc_id for r in kept if r.text is None] == [8, 8]
    assert near_dup.keep_one(empty).count() == 0
    out = near_dup.keep_one(clashing)
    assert out.columns == clashing.columns and sorted(map(str, out.collect())) == sorted(map(str, clashing.collect()))


def test_components(spark):
    pick = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(9, 9), (5, 4), (5, 4)]
    edges += [(pick.randint(2000, 2400), pick.randint(2000, 2400)) for _ in range(200)]
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    want = {x: root(x) for x in parent}
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {v: got.get(v, v) for v in want} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_texts_are_dealt_only_where_signatures_may_link(spark, monkeypatch):
    """Unlike texts that share buckets by a common template: signatures are dealt, hardly any text is."""
    import random

    from tablehaul.llm import near_dup

    monkeypatch.setattr(near_dup, "SIDE", 16)
    pick = random.Random(8)
    shared = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join([*shared, *(f"own{i}x{j}" for j in range(200))])) for i in range(240)]
    rows += [(1000 + i, rows[i][1] + f" more{i}") for i in range(0, 240, 40)]
    pick.shuffle(rows)
    counts = {}
    plain = near_dup.in_blocks

    def counted(dealt, nodes, columns):
        counts[tuple(columns)] = counts.get(tuple(columns), 0) + dealt.count()
        return plain(dealt, nodes, columns)

    monkeypatch.setattr(near_dup, "in_blocks", counted)
    monkeypatch.setattr(near_dup, "HUB_TURNS", 0)
    monkeypatch.setattr(near_dup, "SMALL", 2)
    out = {r.doc_id: r.component_id for r in near_dup.near_dup_rows(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert out == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert counts["signature",] > 1000 and counts["signature",] > 10 * counts["signature", "text"], counts


def test_shuffle_files_go_with_their_step(spark):
    """Only the last step's shuffle files are left when the groups are known; settings stay as they were."""
    import time

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in map(str, files.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before, setting = shuffled(), spark.conf.get(name)
    df = spark.createDataFrame(near_copies(), "doc_id bigint, text string").repartition(4)
    found = near_dup.group(df, k=4)
    until = time.time() + 20
    while time.time() < until and shuffled() - before:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(name) == setting
    assert found.count() == df.count()
    with pytest.raises(ZeroDivisionError), near_dup.shuffles_deleted(spark):
        assert spark.conf.get(name) == "true"
        1 / 0
    assert spark.conf.get(name) == setting
