"""Repeated passages of whole lines against plain Python."""

import re

from pyspark.sql import functions as F

from tablehaul.llm import line_chunks
from tests.llm import brute
from tests.llm.test_line_chunks import cut

OVER = line_chunks.PASSAGE


def spans(text):
    """The shortest runs of lines of over ``OVER`` words, by their first and by their last line."""
    lines = text.split("\n")
    n = [len(brute.WORD.findall(x)) for x in lines]
    out = set()
    for i in range(len(lines)):
        for step in (1, -1):
            j, total = i, n[i]
            while total <= OVER and 0 <= j + step < len(lines):
                j += step
                total += n[j]
            if n[i] and total > OVER:
                out.add((min(i, j), max(i, j)))
    return out


def expected(rows, parts):
    """(left text, lines gone) per row of ascending ids."""
    seen, out = set(), []
    for (_, text), cs in zip(rows, parts):
        lines, gone = text.split("\n"), set()
        counted = {(c.first, c.last) for c in cs if sum(bool(brute.WORD.search(x)) for x in c.text.split("\n")) > 1 or len(brute.WORD.findall(c.text)) >= line_chunks.LONG_LINE}
        for a, b in sorted(spans(text) | counted):
            run = "\n".join(lines[a : b + 1])
            if run in seen:
                gone.update(range(a, b + 1))
            seen.add(run)
        i = 0
        while i < len(lines):  # blank lines between lines that go
            j = i
            while j < len(lines) and j not in gone and not brute.WORD.search(lines[j]):
                j += 1
            if i > 0 and i - 1 in gone and j in gone:
                gone.update(range(i, j))
            i = max(j, i + 1)
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def dedup(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.text, r.removed) for r in line_chunks.dedup_passages(df).orderBy("id").collect()]


def passage(n_lines, name, blank=False):
    """A passage of 56 words in so many lines of under 40."""
    words = [f"{name}{i}" for i in range(56)]
    size = -(-56 // n_lines)
    return ("\n\n" if blank else "\n").join(" ".join(words[i : i + size]) for i in range(0, 56, size))


def test_passages_of_short_lines_go_whole(spark):
    rows = []
    for n in range(2, 9):
        for blank in (False, True):
            p = passage(n, f"p{n}{blank}x", blank)
            rows += [(len(rows) + k, f"own {len(rows) + k}\n{p}\nafter {len(rows) + k}") for k in range(4)]
    for i, (text, removed) in enumerate(dedup(spark, rows)):
        whole = rows[i][1]
        assert (text, removed) == ((whole, 0) if i % 4 == 0 else (f"own {i}\nafter {i}", whole.count("\n") - 1))


def test_fifty_words_in_short_lines_are_no_passage(spark):
    fifty = [" ".join(f"f{i}w{j}" for j in range(25)) for i in range(2)]
    df = spark.createDataFrame([("\n".join(fifty),), ("\n".join([*fifty, "one"]),)], "text string")
    got = [r.w for r in df.select(line_chunks.windows(line_chunks.marked(F.col("text"))).alias("w")).collect()]
    assert [{tuple(x) for x in w} for w in got] == [set(), {(0, 2)}]


def test_documents_against_brute_force(spark, documents, texts):
    rows = sorted(texts.items())
    parts = cut(spark, [t for _, t in rows])
    want = expected(rows, parts)
    got = [(r.text, r.removed) for r in line_chunks.dedup_passages(documents).orderBy("id").collect()]
    assert got == want
    assert sum(n for _, n in got) > 0


def test_no_line_is_lost(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, "\n".join([a] * 5)), (2, f"{a}\n{b}\n{a}\n{b}\n{c}"), (3, f"{b}\n{c}\n\n \n{a}\n{b}")]
    got = dedup(spark, rows)
    assert got == expected(rows, cut(spark, [t for _, t in rows]))
    assert {x for t, _ in got for x in re.split("\n", t) if x.strip()} == {a, b, c}


def test_odd_empty_and_clashing(odd, empty, clashing):
    out = [(r.id, r.text, r.removed) for r in line_chunks.dedup_passages(odd).collect()]
    assert len(out) == odd.count()
    assert [t for k, t, _ in out if k == 1] == [None] and [t for k, t, _ in out if k == 2] == [""] and [t for k, t, _ in out if k == 11] == ["\n\n\n"]
    assert line_chunks.dedup_passages(empty).count() == 0
    assert line_chunks.dedup_passages(clashing).count() == 4


def test_hashes_that_clash_do_not_take_a_line_out(spark, monkeypatch):
    """Runs are compared by their bytes, so hashes that are all the same change nothing."""
    rows = [(i, f"first of {i}\n{passage(3, 'same')}\n{passage(2, f'own{i}x')}\nlast of {i}") for i in range(6)]
    want = dedup(spark, rows)
    plain = line_chunks.units
    same = lambda *a: F.transform(plain(*a), lambda u: u.withField("h1", F.lit(0).cast("bigint")).withField("h2", F.lit(0).cast("bigint")))
    monkeypatch.setattr(line_chunks, "units", same)
    assert dedup(spark, rows) == want == expected(rows, cut(spark, [t for _, t in rows]))


def test_seventy_words_in_six_lines_go_everywhere_but_first(spark):
    lines = [" ".join(f"l{i}w{j}" for j in range(12)) for i in range(6)]
    rows = [(d, "\n".join([f"before {d}", *lines, f"behind {d}"])) for d in range(30)]
    out = dedup(spark, rows)
    assert out[0] == (rows[0][1], 0) and all(out[d] == (f"before {d}\nbehind {d}", 6) for d in range(1, 30))
