"""Each stage against a plain version of what it should keep."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from weeklane.llm.toxicity import toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def steps(spark, hard_dir):
    docs = spark.read.parquet(f"{hard_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, hard_dir), name)
        out.append(docs)
    return [x.collect() for x in out], [x.columns for x in out]


def test_columns_stay(steps):
    assert all(set(c) == set(steps[1][0]) for c in steps[1][1:-1])


def test_toxic_go(spark, hard_dir, steps):
    docs = spark.read.parquet(f"{hard_dir}/documents.parquet")
    scores = toxicity(docs, spark.read.parquet(f"{hard_dir}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2).collect()
    expected = {r.doc_id for r in scores if r.score < 0.3}
    assert {r.doc_id for r in steps[0][1]} == expected and len(steps[0][0]) == len(scores)


def test_rows_with_one_id_or_none_are_rows_of_their_own(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, "quite another text of a few words more", "en", "a", 1), (None, text, "en", None, 1), (None, None, "en", None, 1), (None, None, "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k in range(2):  # two files, whose places repeat
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    own = corpus_pipeline.numbered(docs)
    assert own.select(corpus_pipeline.ROW).distinct().count() == 12
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.text or "" for r in kept) == ["", "", "", "", text, rows[2][1]]


def test_one_of_each_group_stays(steps):
    before, after = steps[0][1], {r.doc_id for r in steps[0][2]}
    groups = {}
    for d, (_, c) in brute.near_copies([(r.doc_id, r.text) for r in before], 5).items():
        groups.setdefault(c, []).append(d)
    assert all(len(after & set(g)) == 1 for g in groups.values())


def test_contaminated_go(spark, hard_dir, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{hard_dir}/benchmark.parquet").collect()]
    bad = {d for d, x in brute.contamination([(r.doc_id, r.text) for r in steps[0][2]], items).items() if x[4]}
    assert {r.doc_id for r in steps[0][2]} - {r.doc_id for r in steps[0][3]} == bad


def test_secrets_are_hidden(steps):
    before = {r.doc_id: r.text for r in steps[0][3]}
    assert len(before) == len(steps[0][4])
    for r in steps[0][4]:
        assert not brute.secrets(r.text)
        if not brute.secrets(before[r.doc_id]) and "[secret]" not in (r.text or ""):
            assert r.text == before[r.doc_id]
        assert r.text is None or r.n_chars == len(r.text)


def test_mix_takes_words(steps):
    assert all(0 < r.taken <= 2 * r.size for r in steps[0][5])
    size, taken = Counter(), Counter()
    for r in steps[0][4]:
        size[r.source] += len(brute.WORD1.findall(r.text or ""))
    for r in steps[0][5]:
        taken[r.source] += r.taken
    goal = brute.mix_targets(size)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
