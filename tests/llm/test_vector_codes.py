import hashlib
import math

import numpy as np
import pytest

from tablehaul.llm import vector_codes
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=4):
    """rows: (id, vector, label), as floats of 4 bytes; exact whole numbers throughout."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 24), min(1 << 24, x)) for x in v], lab) for i, v, lab in kept]
    if not kept:
        return [], None
    width = -(-max(len(v) for _, v, _ in kept) // 4)
    kept = [(i, v + [0] * (4 * width - len(v)), lab) for i, v, lab in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    data = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), 4, width)
    books = data[:256].transpose(1, 0, 2).copy()

    def assign():
        return np.stack([np.stack([((data[:, p] - c) ** 2).sum(axis=1) for c in books[p]], axis=1).argmin(axis=1) for p in range(4)], axis=1)

    for _ in range(rounds):
        codes = assign()
        for p in range(4):
            for e in range(len(books[p])):
                members = data[codes[:, p] == e, p]
                if len(members):
                    books[p, e] = members.sum(axis=0) // len(members)
    codes = assign()
    errors = sum(((data[:, p] - books[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(4)).tolist()
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    out = [(i, "".join(f"{c:02x}" for c in code), e, by_label[lab], digest) for (i, _, lab), code, e in zip(kept, codes.tolist(), errors)]
    return sorted(out, key=repr), books


@pytest.fixture
def found():
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return lambda df: sorted((tuple(r[c] for c in columns) for r in vector_codes.vector_rows(df).collect()), key=repr)


def random_rows(seed, n, width, spread=1.0, ties=False):
    rng = np.random.default_rng(seed)
    data = rng.normal(0, spread, (n, width)).astype(np.float32)
    if ties:
        data = np.round(data * 2) / 2
    return [(int(i), [float(x) for x in v], int(i) % 7 if i % 5 else None) for i, v in zip(rng.permutation(n), data)]


def test_given_embeddings(spark, found):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert found(df) == brute(rows)[0]


@pytest.mark.parametrize("n, width, spread, ties", [(900, 16, 0.2, False), (1500, 8, 1.0, True), (700, 12, 3000.0, False), (60, 8, 1.0, False), (1, 4, 1.0, False), (300, 10, 1.0, True)])
def test_against_brute_force(spark, found, n, width, spread, ties):
    rows = random_rows(n, n, width, spread, ties)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)[0]


def test_odd_vectors(spark, found):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(4, 300, 8) + [
        (1000, None, 1), (1001, [1.0, None] + [0.0] * 6, 1), (1002, [nan] * 8, 2), (1003, [inf] + [0.0] * 7, 2), (1004, [-inf] + [0.0] * 7, 2),
        (None, [0.25] * 8, None), (5, [0.5] * 8, 3), (5, [0.5] * 8, 3), (-9, [1e30, -1e30] * 4, 3), (1005, [], 4), (1006, [0.1] * 3, 4), (1007, [-0.0001] * 8, 4),
    ]
    plain = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)[0]
    assert len(want) == 300 + 7
    assert found(plain) == want
    assert found(plain.selectExpr("*", "1 AS q", "2 AS rest", "3 AS code", "4 AS error", "5 AS vector", "6 AS ids", "7 AS k")) == want


def test_empty_and_nothing_kept(spark, found):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 2)], SCHEMA)) == []


def test_other_columns_come_along(spark):
    rows = random_rows(8, 300, 8)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id AS key", "embedding AS v", "label", "'x' AS code", "cast(null AS string) AS q")
    coded, books = vector_codes.compress(df, key="key", vector="v")
    assert coded.schema["rest"].dataType.names == df.columns and coded.count() == 300
    assert (books == brute(rows)[1]).all()


@pytest.mark.parametrize("keep", [1, 3, 40])
def test_bounds_stay_below_the_distances(keep):
    """After many small moves no bound is above the distance it stands for, and codes are exact."""
    rng = np.random.default_rng(keep)
    parts, entries = rng.integers(-2000, 2000, (400, 5)), rng.integers(-2000, 2000, (64, 5))
    bounds, had = vector_codes.Bounds.of(vector_codes.squared(parts, entries), keep), keep
    whole = 0
    for turn in range(6):
        moved_to = entries + rng.integers(-60, 61, entries.shape) // (turn + 1)
        drift = np.sqrt(((moved_to - entries) ** 2).sum(axis=1)) * (1 + 1e-9)
        entries = moved_to
        had = max(1, had - (turn == 3))
        bounds, looked = vector_codes.reassign(parts, entries, drift, bounds, had)
        true = vector_codes.squared(parts, entries)
        assert (bounds.code == true.argmin(axis=1)).all()
        far = np.sqrt(true.astype(float))
        assert (bounds.lower <= np.take_along_axis(far, bounds.ids.astype(np.int64), axis=1)).all()
        rest = far.copy()
        rest[np.arange(len(parts)), bounds.code] = np.inf
        np.put_along_axis(rest, bounds.ids.astype(np.int64), np.inf, axis=1)
        assert (bounds.outer <= rest.min(axis=1)).all()
        assert bounds.ids.shape[1] == had
        whole += int((looked == len(entries)).sum())
    assert whole < 6 * len(parts)  # bounds spared some of the full passes


def test_kept_bounds_follow_use(spark):
    looked = [[0, 0, 1, 2]] * 400 + [[0, 7, 256, 1]]
    rows = [(bytearray(np.array(x, "<u2").tobytes()),) for x in looked]
    assert vector_codes.bounds_to_keep(spark.createDataFrame(rows, "looked binary"), 32) == max(vector_codes.KEEP_LEAST, 3)
    many = [(bytearray(np.array([20] * 4, "<u2").tobytes()),)] * 50
    assert vector_codes.bounds_to_keep(spark.createDataFrame(many, "looked binary"), 32) == 21
