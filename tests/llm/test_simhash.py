import random

import numpy as np
import pytest
import xxhash

from tablehaul.llm import simhash
from tests.llm.brute import WORD
from tests.llm.conftest import ODD, SF


def brute_fingerprint(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    """Least member of the component of each distinct fingerprint."""
    values = np.array(sorted(values), np.uint64)
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return {int(v): int(c) for v, c in zip(values, label)}
        label = new


def brute_rows(rows, k, bits):
    prints = [brute_fingerprint(t, k) for _, t in rows]
    label = brute_components(set(prints), bits)
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return sorted(((i, f"{f:016x}", least.get(label[f])) for (i, _), f in zip(rows, prints)), key=repr)


@pytest.fixture
def found(spark):
    return lambda df, k=4: sorted((tuple(r) for r in simhash.simhash_rows(df, k, 4).collect()), key=repr)


def test_given_documents(spark, documents, found):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = found(documents)
    assert got == brute_rows(rows, 4, 4)
    assert any(i != c for i, _, c in got)


def test_odd_rows(spark, odd, clashing, empty, found):
    assert found(odd) == brute_rows(ODD, 4, 4)
    assert found(empty) == []
    rows = [(r.doc_id, r.text) for r in clashing.select("doc_id", "text").collect()]
    assert found(clashing) == brute_rows(rows, 4, 4)


def test_all_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in simhash.simhash_rows(df, 4, 4).collect()] == [(f"{brute_fingerprint('a b c', 4):016x}", None)] * 2


def test_native_hash_is_the_same(spark):
    texts = ["a", "a b c d", "größe 日本", ""]
    native = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t)").collect()]
    assert [x % (1 << 64) for x in native] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def flipped(value, n, rng):
    for b in rng.sample(range(64), n):
        value ^= 1 << b
    return value


def crowd(seed, n, dense):
    """Random fingerprints, balls around some of them, and crowds that share long runs of bits."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 2)]
    while len(out) < n:
        center = rng.choice(out)
        out.append(flipped(center, rng.choice([1, 2, 3, 4, 4, 5, 6]), rng))
    if dense:
        base = rng.getrandbits(64)
        out += [base ^ (rng.getrandbits(12) << rng.choice([0, 20, 52])) for _ in range(n // 2)]
        out += [flipped(base, rng.choice([0, 2, 4, 7, 9]), rng) for _ in range(n // 2)]
    return list(set(out))


@pytest.mark.parametrize("bits, side, dense", [(4, 4096, True), (4, 20, True), (4, 2, False), (4, 5, True), (3, 6, True), (1, 4, True), (0, 3, True)])
def test_no_link_is_lost_at_any_bucket_size(spark, bits, side, dense):
    """Small sides force every level of the chain and blocks of several sides."""
    values = crowd(bits * 100 + side, 160 if side < 10 else 400, dense)
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "v long")
    edges = [(np.int64(u).view(np.uint64).item(), np.int64(v).view(np.uint64).item()) for u, v in simhash.near_fingerprints(nodes, bits, side).collect()]
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[max(root(u), root(v))] = min(root(u), root(v))
    want = brute_components(values, bits)
    order = sorted(values)
    assert {v: root(v) for v in values} == {v: order[c] for v, c in want.items()}


def test_every_near_pair_shares_a_bucket_at_every_level(spark):
    rng = random.Random(3)
    pairs = [(a := rng.getrandbits(64), flipped(a, rng.choice([0, 1, 2, 3, 4]), rng)) for _ in range(400)]
    names = [[(f"{n}", int(np.uint64(v).view(np.int64))) for n, v in enumerate(side)] for side in zip(*pairs)]
    levels = []
    for rows in names:
        members = simhash.first_buckets(spark.createDataFrame(rows, "n string, v long").select("v").distinct(), 4)
        per_level = []
        for level in range(5):
            keys = {}
            for r in members.collect():
                keys.setdefault(r.v, set()).add((r.i, r.b))
            per_level.append(keys)
            members = simhash.next_buckets(members, level + 1, 4)
        levels.append(per_level)
    for level, (ours, theirs) in enumerate(zip(*levels)):
        for (_, u), (_, v) in zip(*names):
            assert ours[u] & theirs[v], level
        assert max(map(len, ours.values())) <= 5 * [1, 2, 5, 14, 42][level]


def test_edges_of_a_dense_bucket_are_a_forest():
    rng = random.Random(5)
    center = rng.getrandbits(64)
    ball = np.array(list({flipped(center, 2, rng) for _ in range(900)}), np.uint64)
    edges = simhash._block_edges(ball, ball, [0, 0, 0, 0, (1 << 64) - 1], 4)
    assert len(edges) <= 2 * len(ball)
    assert {x for e in edges for x in e} == set(ball.tolist())


def test_fingerprints_of_the_pages_of_one_folder(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.id: r.f % (1 << 64) for r in simhash.fingerprints(df, k=5).collect()}
    some = sorted(texts)[::9]
    assert [got[i] for i in some] == [brute_fingerprint(texts[i], 5) for i in some]
