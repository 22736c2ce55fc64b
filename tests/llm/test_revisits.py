import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablehaul.llm import revisits

SCHEMA = "record_id string, kind string, url string, date timestamp, status int, headers map<string,string>, digest string, payload string"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize(
    "url,key",
    [
        ("HTTP://User@Example.COM:80", "http://example.com/"),
        ("https://x.org:8080/A/b?b=2&utm_source=q&a=1#f", "https://x.org:8080/A/b?a=1&b=2"),
        ("https://x.org:443/?UTM_medium=1", "https://x.org/"),
        ("http://x.org/?a=1&a=1&", "http://x.org/?a=1&a=1"),
        ("http://h:443/a", "http://h:443/a"),
        ("https://h:80/a", "https://h:80/a"),
        ("ftp://h:80", "ftp://h:80/"),
        ("https://h:443", "https://h/"),
        ("http://h:", "http://h/"),
        ("http://h/" + "p" * 40_000, "http://h/" + "p" * 40_000),
        ("nothing", "nothing"),
        (None, None),
    ],
)
def test_canonical(spark, url, key):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(revisits.canonical(F.col("url"))).first()[0] == key


def record(i, kind, url, minutes, headers=None, digest=None, status=200):
    return (i, kind, url, None if minutes is None else at(minutes), status if kind == "response" else 304, headers, digest, f"body {i}" if kind == "response" else None)


def resolved(spark, rows):
    out = revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r.record_id: r for r in out}


def test_headers_and_payload(spark):
    rows = [
        record("a", "response", "http://x.org", 0, {"ETag": '"1"', "Content-Type": "text/html", "Cache-Control": "max-age=1", "Vary": "x"}),
        record("b", "revisit", "HTTP://X.org/#f", 10, {"etag": 'W/"1"', "CACHE-CONTROL": "max-age=9", "Set-Cookie": "s", "Content-Type": "text/plain"}),
    ]
    r = resolved(spark, rows)["b"]
    assert (r.outcome, r.refers_to, r.status, r.payload) == ("resolved", "a", 200, "body a")
    assert r.headers == {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "max-age=9", "vary": "x"}


def test_validators(spark):
    response = [record("a", "response", "u", 0, {"ETag": '"1"', "Last-Modified": "mon"}, "d1"), record("z", "response", "u2", 0)]
    asked = {
        "etag wins": ({"ETag": '"1"', "Last-Modified": "tue"}, "d2", "resolved"),
        "etag differs": ({"ETag": '"2"', "Last-Modified": "mon"}, "d1", "mismatch"),
        "date": ({"last-modified": "mon"}, "d2", "resolved"),
        "date differs": ({"last-modified": "tue"}, "d1", "mismatch"),
        "digest": (None, "d1", "resolved"),
        "digest differs": ({}, "d2", "mismatch"),
        "nothing": (None, None, "unchecked"),
    }
    out = resolved(spark, response + [record(k, "revisit", "u", 5, h, d) for k, (h, d, _) in asked.items()] + [record("none", "revisit", "u2", 5, {"ETag": "x"})])
    assert {k: out[k].outcome for k in asked} == {k: o for k, (*_, o) in asked.items()}
    assert out["none"].outcome == "unchecked"
    assert out["etag differs"].payload is None and out["etag differs"].refers_to == "a"


def test_as_of_search_against_brute_force(spark):
    pick = random.Random(9)
    rows = []
    for i in range(1500):
        kind = pick.choice(["response", "revisit"])
        url = pick.choice(["hot", "hot", "hot", *"abcdef"])  # half of all rows are one url's
        rows.append(record(f"r{i:04}", kind, url, pick.randrange(0, 3000, 5), status=pick.choice([200, 200, 404])))
    out = resolved(spark, rows)
    for i, kind, url, date, *_ in rows:
        if kind == "revisit":
            earlier = [(x[3], x[0]) for x in rows if x[1] == "response" and x[4] == 200 and x[2] == url and x[3] < date]
            assert out[i].refers_to == (max(earlier)[1] if earlier else None)
    small = revisits.resolve(spark.createDataFrame(rows, SCHEMA), bucket_seconds=600)
    assert {r.record_id: r.refers_to for r in small.collect()} == {k: r.refers_to for k, r in out.items()}


def test_odd_empty_and_clashing(spark):
    rows = [
        record("a", "response", "u", 0), record("a", "response", "u", 0), record(None, "response", "u", 1), record("n", "response", None, 0), record("t", "response", "u", None),
        record("b", "revisit", "u", 5), record("b", "revisit", "u", 5), record("c", "revisit", None, 5), record("d", "revisit", "u", None), record(None, "revisit", "u", 5), record("e", "revisit", "u", 0), record("f", None, "u", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.record_id, r.outcome, r.refers_to) for r in revisits.resolve(df).collect()), key=str)
    assert got == sorted([("b", "unchecked", "a")] * 2 + [("c", "orphan", None), ("d", "orphan", None), (None, "unchecked", "a"), ("e", "orphan", None)], key=str)
    assert revisits.resolve(df.limit(0)).count() == 0
    more = df.withColumns({c: F.lit(1) for c in ("key", "bucket", "found", "stored", "outcome", "turn", "id", "ref")})
    assert revisits.resolve(more).count() == 6


def test_one_id_with_different_contents(spark):
    """Whatever the order of the rows, the same response answers."""
    def body(text, digest, minutes=0):
        return ("a", "response", "u", at(minutes), 200, {"ETag": '"1"', "X": "h" * 20_000}, digest, text)

    asked = [record("b", "revisit", "u", 5), record("c", "revisit", "u", 15)]
    some = [body("A", "d1"), body("B", "d2"), body("C", "d2"), body("old", None), body("later", "d0", 10)]
    for rows in (some, some[::-1]):
        out = resolved(spark, rows + asked)
        assert (out["b"].payload, out["b"].refers_to_date) == ("C", at(0))
        assert (out["c"].payload, out["c"].refers_to_date) == ("later", at(10))


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = revisits.revisit_rows(pages).collect()
    assert len(rows) == pages.count()
    assert {r.outcome for r in rows} >= {"resolved", "mismatch", "orphan"}
    assert all((r.payload_sha256 is not None) == (r.outcome in ("resolved", "unchecked")) for r in rows)
