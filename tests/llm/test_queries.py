"""The queries against plain versions, on hard rows, and on empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from weeklane.llm.queries import queries

Q = queries()


def name_of(n):
    return next(k for k in Q if k.startswith(f"op{n}_"))


def rows(spark, n, path):
    return Q[name_of(n)](spark, path).collect()


@pytest.mark.parametrize("n", range(1, 14))
def test_empty(spark, empty_dir, n):
    assert rows(spark, n, empty_dir) == []


def test_near_copies(spark, hard_dir, hard_docs):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, 1, hard_dir)}
    assert found == {d: (*x, x[1] == d) for d, x in brute.near_copies(hard_docs).items()}
    assert len({found[d][1] for d in (6, 7, 8, 9, 10)}) == 1
    assert found[0] == (0, 0, True) and found[2] == (0, 2, True)


def test_contamination(spark, hard_dir, hard_docs):
    t = pq.read_table(f"{hard_dir}/benchmark.parquet")
    expected = brute.contamination(hard_docs, list(zip(t["item_id"].to_pylist(), t["text"].to_pylist(), strict=True)))
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows(spark, 2, hard_dir)}
    assert found == expected
    assert found[26][4] and found[27][4] and found[28][:3] == (2, 2, 1)


def test_mix(spark, hard_dir, hard_docs):
    source = dict(zip(*(pq.read_table(f"{hard_dir}/documents.parquet")[c].to_pylist() for c in ("doc_id", "source")), strict=True))
    size = {d: len(brute.WORD1.findall(t or "")) for d, t in hard_docs}
    total, taken = Counter(), Counter()
    for d, k in size.items():
        total[source[d]] += k
    goal = brute.mix_targets(total)
    found = rows(spark, 3, hard_dir)
    assert len(found) == len(size)
    for r in found:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert math.isclose(r.target, goal[source[r.doc_id]]) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert sorted(found) == sorted(rows(spark, 3, hard_dir))


def test_secrets(spark, hard_dir, hard_docs):
    text = dict(hard_docs)
    found = {r.doc_id: r for r in rows(spark, 4, hard_dir)}
    assert set(found) == set(text)
    for d, r in found.items():
        base = brute.secrets(text[d])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("owned")] == base
    assert found[23].spans.count("owned") in (1, 2) and "owned:27:" in found[23].spans  # the other value may have two owners


def test_nearest(spark, hard_dir):
    t = pq.read_table(f"{hard_dir}/embeddings.parquet")
    good = {i: np.array(v, np.float64) for i, v in zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True) if v and len(v) == 6 and None not in v and np.isfinite(v).all() and any(v)}
    found = defaultdict(list)
    for r in rows(spark, 5, hard_dir):
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in good if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        expected = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:20]
        assert [g[0] for g in sorted(got)] == list(range(1, 21))
        assert all(math.isclose(s, float(good[q] @ good[i]), abs_tol=1e-12) for _, i, s in got)
        hits += len({i for _, i in expected} & {g[1] for g in got})
    assert hits >= 0.9 * 20 * len(found)


def test_urls(spark, hard_dir):
    t = pq.read_table(f"{hard_dir}/pages.parquet")
    url = dict(zip(t["page_id"].to_pylist(), t["url"].to_pylist(), strict=True))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows(spark, 6, hard_dir)} == {p: brute.judge(u) for p, u in url.items()}


def test_tokens(spark, hard_dir, hard_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(spark, 7, hard_dir):
        text = dict(hard_docs)[r.doc_id] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_repeats(spark, hard_dir, hard_docs):
    short = {d: t for d, t in hard_docs if len(t or "") < 20_000}
    found = {r.doc_id: tuple(r)[:5] for r in rows(spark, 8, hard_dir)}
    # brute() holds all strings of the two long texts too
    expected = {x[0]: x for x in brute.repeats(hard_docs)}
    assert found == expected and len(short) < len(found)


def test_toxicity_uses_its_labels_only(spark, hard_dir, hard_docs):
    found = rows(spark, 9, hard_dir)
    assert len(found) == len(hard_docs)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_lattice(spark, hard_dir, hard_docs):
    words = {d: brute.WORD1.findall((t or "").translate(brute.UP)) + [None] for d, t in hard_docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    c = Counter(w for d in words if not held[d] for w in words[d])
    n, v = sum(c.values()), len(c)
    found = rows(spark, 10, hard_dir)
    assert len(found) == len(words)
    for r in found:
        own = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
