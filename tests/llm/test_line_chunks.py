from collections import Counter

from pyspark.sql import functions as F

from tablehaul.llm import line_chunks


def cut(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [r.c for r in df.select(line_chunks.chunks(F.col("text")).alias("c"), "i").orderBy("i").collect()]


def test_chunks_make_up_the_text(spark, texts):
    values = list(texts.values()) + ["", "\n", "a\n\nb", "\n\n\n"]
    parts = cut(spark, values)
    assert ["\n".join(c.text for c in p) for p in parts] == values
    assert all(c.first == c.last for p in parts for c in p if any(len(x.split()) >= line_chunks.LONG_LINE for x in c.text.split("\n")))


def test_boundaries_resist_shifts(spark):
    lines = [f"line number {i} of the text" for i in range(200)]
    a, b = cut(spark, ["\n".join(lines), "\n".join(["put in before", *lines[:100], "and in the middle", *lines[100:]])])
    same = Counter(c.text for c in a) & Counter(c.text for c in b)
    assert sum(same.values()) >= len(a) - 4


def test_long_passage_goes_everywhere_but_first(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own line {i}\n{passage}\nlast {i}") for i in range(40)]
    out = {r.id: (r.text, r.removed) for r in line_chunks.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == (rows[0][1], 0)
    assert all(out[i] == (f"own line {i}\nlast {i}", 1) for i in range(1, 40))


def test_short_single_lines_stay(spark):
    rows = [(i, f"all rights reserved\n{' '.join(f'w{i}x{j}' for j in range(50))}") for i in range(20)]
    out = line_chunks.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: r.text for r in out.collect()} == dict(rows)


def test_repeats_inside_one_document(spark):
    long = " ".join(f"z{i}" for i in range(50))
    out = line_chunks.dedup_passages(spark.createDataFrame([(1, f"{long}\nx\n{long}\n{long}")], "doc_id long, text string")).first()
    assert out.text == f"{long}\nx" and out.removed == 2


def test_odd_empty_and_clashing(odd, empty, clashing):
    out = [(r.id, r.text, r.removed) for r in line_chunks.dedup_passages(odd).collect()]
    assert len(out) == odd.count()
    assert [t for k, t, _ in out if k == 1] == [None] and [t for k, t, _ in out if k == 2] == [""]
    assert [t for k, t, _ in out if k is None] == ["a null id has a text of its own here"]
    assert line_chunks.dedup_rows(empty).count() == 0
    assert line_chunks.dedup_passages(clashing).count() == 4


def test_null_ids_are_cleaned_too(spark):
    long = " ".join(f"z{i}" for i in range(50))
    rows = [(None, f"a\n{long}"), (None, f"b\n{long}"), (3, f"c\n{long}")]
    out = sorted(r.text for r in line_chunks.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(long in t for t in out) == 1 and "c" in out
