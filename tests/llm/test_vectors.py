"""Whitening, hard negatives and fingerprints against plain versions, on hard rows."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from weeklane.llm import fingerprints, hard_negatives, whitening
from weeklane.llm.queries import oracle_sql, queries

Q = queries()


def exact(rows):
    """(usable ids, n, S, x) of the contract, in whole numbers."""
    good = [(i, [int(np.floor(1024 * np.float64(c))) + 100_000 for c in v]) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    sizes = [len(v) for _, v in good]
    dim = max(set(sizes), key=lambda k: (sizes.count(k), k))
    good = [(i, v) for i, v in good if len(v) == dim]
    return good, len(good), [sum(v[d] for _, v in good) for d in range(dim)]


def check_whitened(found, rows, components=8):
    good, n, total = exact(rows)
    x = np.array([v for _, v in good], float)
    cov = [[Fraction(n * sum(a[i] * a[j] for _, a in good) - total[i] * total[j], n * n) for j in range(len(total))] for i in range(len(total))]
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in r] for r in cov]))
    k = min(components, len(total))
    assert len(found) == n * k and {r.n for r in found} == {n}
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    for (i, v), row in zip(good, x, strict=True):
        own = by_id[i]
        assert sorted(own) == list(range(1, k + 1))
        dev = sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True))
        assert {r.deviation for r in own.values()} == {dev if dev < 1 << 63 else None}
        for c in range(1, k + 1):
            plain = (row - np.array(total) / n) @ vectors[:, -c] / np.sqrt(values[-c])
            assert min(abs(own[c].whitened - plain), abs(own[c].whitened + plain)) < 1e-6
            assert abs(own[c].explained - values[-c] / values.sum()) < 1e-9
            assert own[c].identity_error < 1e-6


def test_whitening_hard_rows(spark, hard_dir):
    t = pq.read_table(f"{hard_dir}/embeddings.parquet")
    check_whitened(Q["op11_polar_whitening"](spark, hard_dir).collect(), list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)))


def test_covariances_stay_exact_for_far_values(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) * 10.0**e for e in (0, 3, 9)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    done, model, error = whitening.whiten(df)
    good, n, total = exact(rows)
    assert (model.n, model.sums) == (n, total) and error < 1e-4
    assert {q.vec_id: int(q.deviation) for q in done.collect()} == {i: sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True)) for i, v in good}


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [0.5, 0.5])], [(1, [1e300, 0.0]), (2, [-1e300, 1.0])]])
def test_whitening_without_variance(spark, rows):
    done, model, error = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = done.collect()
    assert len(found) == len(rows) and all(len(r.whitened) == 2 for r in found)
    for r in found:
        assert [w is not None for w in r.whitened] == list(model.scaled)
    assert (error is None) == (not model.scaled.any())


def mining_rows(n, dim, seed, labels=4):
    r = np.random.default_rng(seed)
    vec = [list(map(float, v)) for v in np.round(r.standard_normal((n, dim)) / np.sqrt(dim) + 0.2, 2)]
    rows = [(i, vec[i], int(r.integers(0, labels))) for i in range(n)]
    common = vec[7]
    rows += [(n + i, common, i % 2) for i in range(n // 3)]  # one vector in many rows
    rows += [(0, vec[0], 1), (0, vec[0], 1), (50, vec[3], None), (None, vec[4], 2), (100, None, 1), (150, [], 1), (200, [1.0], 1), (250, [float("nan")] * dim, 1), (300, [None] * dim, 1), (350, [0.0] * dim, 0)]
    return rows


@pytest.fixture(scope="module")
def mining_dir(tmp_path_factory):
    path, rows = tmp_path_factory.mktemp("mining"), mining_rows(400, 20, 5)
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32()), "row": ["x"] * len(rows), "id": [1] * len(rows), "block": [2] * len(rows)}), f"{path}/embeddings.parquet")
    return str(path)


def test_hard_negatives_as_in_sql(spark, mining_dir):
    con = connect(mining_dir, ["embeddings"])
    assert difference(spark, con, Q["op13_bond_negatives"], oracle_sql()["op13_bond_negatives"], mining_dir) is None


def test_hard_negatives_do_not_depend_on_the_dealing(spark, mining_dir, monkeypatch):
    whole = sorted(Q["op13_bond_negatives"](spark, mining_dir).collect(), key=str)
    assert len(whole) > 100
    monkeypatch.setattr(hard_negatives, "CELLS", 20 * 150)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 6)
    assert sorted(Q["op13_bond_negatives"](spark, mining_dir).collect(), key=str) == whole


def far_rows(spark, scale):
    base = [([1.0, 1.0], 0), ([1.0, 1.0 - 2.0**-20], 0), ([0.75, 0.75], 1), ([0.75, 0.75 - 2.0**-20], 1), ([0.9, 0.9], 1), ([2.0, -1.0], 1)]
    df = spark.createDataFrame([(i, [c * scale for c in v], k) for i, (v, k) in enumerate(base)], "vec_id long, embedding array<double>, label int")
    return sorted((r.positive_id, r["rank"], r.negative_id) for r in hard_negatives.mined(df, F.col("vec_id") == 0).collect())


def test_hard_negatives_of_far_values(spark):
    assert far_rows(spark, 2.0**20) == [(1, 1, 4), (1, 2, 2), (1, 3, 3)]  # beyond double precision
    assert far_rows(spark, 2.0**40) == []  # all scores are the largest of 64 bits, none in a window


def test_scan_keeps_what_a_full_score_keeps():
    r = np.random.default_rng(1)
    x = r.integers(-200, 200, (500, 33))
    held = pa.table({"x": pa.array(x.tolist(), pa.list_(pa.int64())), "id": np.arange(500), "row": np.arange(500), "label": np.zeros(500, int)})
    block = hard_negatives.Block(held, 33, 200)
    read = []
    for a in x[:20]:
        keep = hard_negatives.among_best(5)
        places, scores = block.scan(a, np.arange(500), lambda lower, upper: (read.append(len(lower)), keep(lower, upper))[1])
        top = block.best(places, scores, 5)
        assert places[top].tolist() == np.argsort(-(x @ a), kind="stable")[:5].tolist()
    assert min(read) < 250  # the bitmap did shrink


def test_fingerprints_merge_and_tell_containment(spark):
    r = random.Random(9)
    text = " ".join(f"w{r.randint(0, 9**6)}" for _ in range(6_000))
    part = " ".join(text.split()[2_000:3_000])
    other = " ".join(f"v{r.randint(0, 9**6)}" for _ in range(900))
    df = spark.createDataFrame([(text, part, other, "")], "a string, b string, c string, d string")
    for c in "abcd":
        df = fingerprints.fingerprinted(df, c, f"s{c}")
    row = df.select(
        fingerprints.contained(F.col("sb"), F.col("sa")).alias("inside"), fingerprints.contained(F.col("sa"), F.col("sb")).alias("holds"), fingerprints.contained(F.col("sc"), F.col("sa")).alias("apart"),
        fingerprints.likeness(F.col("sd"), F.col("sd")).alias("empty"), fingerprints.merged(F.array("sa", "sc")).alias("both"), "sa", "sc",
    ).first()
    assert row.inside == 1 and 0.1 < row.holds < 0.25 and row.apart == 0 and row.empty == 1
    assert row.both == sorted(set(row.sa) | set(row.sc)) and 600 < len(row.sa) < 900


def test_fingerprints_of_repeated_and_missing_ids(spark, tmp_path):
    ids = [5, 5, None, None, 3, 9, 5]
    texts = ["a b c d e f g", "a b c d e f g", None, "tail of all", "short", "é" * 10, "x" * 9]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "key": ["k"] * 7, "next": ["n"] * 7}), f"{tmp_path}/documents.parquet")
    con = connect(str(tmp_path), ["documents"])
    assert difference(spark, con, Q["op12_scaled_sketch"], oracle_sql()["op12_scaled_sketch"], str(tmp_path)) is None
    same = [r.fingerprint for r in Q["op12_scaled_sketch"](spark, str(tmp_path)).collect() if r.doc_id == 5 and r.n_chars == 13]
    assert len(same) == 2 and len(set(same)) == 1
    short = [r.fingerprint for r in Q["op12_scaled_sketch"](spark, str(tmp_path)).collect()]
    assert sum(f == "" for f in short) == 1  # only the null text


def test_successors_run_once_round_all_rows(spark):
    df = spark.range(1000).selectExpr("struct(id AS file, id AS at) AS key", "id div 3 AS id", "'x' AS tie").repartition(7)
    nexts = {r.key.at: r.next.at for r in fingerprints.successors(df).collect()}
    at, seen = 0, set()
    while at not in seen:
        seen.add(at)
        at = nexts[at]
    assert len(seen) == 1000 and at == 0
