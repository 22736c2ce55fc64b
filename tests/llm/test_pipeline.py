import re
from collections import Counter

import corpus_pipeline
from tablehaul.llm import quality
from tests.llm import brute
from tests.llm.test_bpe import want as encoded
from tests.llm.test_decontaminate import wanted as contaminated
from tests.llm.test_line_chunks import cut
from tests.llm.test_passages import expected as passages

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, benchmark = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name == "quality rules":
            good = {r.doc_id for r in quality.quality_rows(docs).collect() if r.kept}
            assert rows_of(after) == [(k, t) for k, t in before if k in good]
            assert not [k for k in good if brute.quality(dict(before)[k])[-1]]
        elif name == "line dedup":
            left = dict(zip([k for k, _ in before], [t for t, _ in passages(before, cut(spark, [t for _, t in before]))]))
            assert rows_of(after) == [(k, left[k]) for k, t in before if brute.WORD.search(left[k]) or left[k] == t]
            assert left != dict(before)
            assert all(r.n_chars == len(r.text) for r in after.collect())
        elif name == "near duplicates":
            roots = brute.near_groups([t for _, t in before], 5)
            assert rows_of(after) == [row for j, row in enumerate(before) if roots[j] == j]
        elif name == "benchmark decontamination":
            hit = {d for d, *_ in contaminated(before, benchmark)}
            assert rows_of(after) == [(k, t) for k, t in before if k not in hit]
        else:
            import tokenizers

            from tablehaul.llm import bpe

            library = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
            got = sorted((r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in after.collect())
            assert got == [(k, encoded(library, t)) for k, t in before]
            continue
        assert after.columns == columns
        docs = after


def test_run_is_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < 200


def test_stages_take_odd_rows(spark, clashing, empty):
    for frame in (clashing, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() <= frame.count()
            if not re.search("bpe", name):
                assert out.columns == frame.columns


def test_odd_rows_at_every_stage(spark, odd):
    """Null ids, null and empty texts, repeated rows and a text of 60,000 words."""
    rows = odd.selectExpr("doc_id", "text", "'en' AS lang", "cast(null AS string) AS source", "cast(length(text) AS long) AS n_chars")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF).collect()
        left[name] = sorted((str(r.doc_id) for r in out))
    before = sorted(str(r.doc_id) for r in odd.collect())
    assert left["quality rules"] == ["7", "8"]
    assert left["benchmark decontamination"] == left["bpe encoding"] == before
    gone = Counter(before) - Counter(left["near duplicates"])
    assert gone == Counter({"5": 1, "6": 1, "8": 1})  # rows 5, 5, 6 are copies, 7 and 8 near ones; texts without words stay
    assert Counter(before) - Counter(left["line dedup"]) == Counter()


def test_emptied_documents_go_and_others_stay(spark):
    long = " ".join(f"z{i}" for i in range(50))
    rows = [(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, "", "en", "s", 0), (4, None, "en", "s", None), (5, f"x\n{long}", "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, df, SF).collect())
    assert got == [(1, long), (3, ""), (4, None), (5, "x")]
