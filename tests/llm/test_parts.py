"""Parts of the operators against plain versions."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weeklane.llm import bpe_count, lattice_lm, minhash, repeats, secret_scan, toxicity, url_cascade, winnowing


@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=12, max_size=12)), min_size=1, max_size=14), st.integers(2, 5))
@settings(max_examples=200, deadline=None)
def test_column_wise_matches(rows, size):
    rows = sorted(rows)
    cells = np.array([[ord(c) for c in t] for _, t in rows], np.uint16)
    r = random.Random(len(rows))
    low = np.array([r.randint(0, 4) for _ in rows])
    high = np.array([r.randint(8, 12) for _ in rows])
    for i in range(len(rows)):
        cells[i, : low[i]] = 256
        cells[i, high[i] :] = 256
    found = repeats.covered(cells, np.array([g for g, _ in rows]), low, high, size)
    expected = np.zeros_like(found)
    for i, j in itertools.permutations(range(len(rows)), 2):
        if rows[i][0] == rows[j][0]:
            for a in range(max(low[i], low[j]), min(high[i], high[j]) - size + 1):
                if (cells[i, a : a + size] == cells[j, a : a + size]).all():
                    expected[i, a : a + size] = True
    assert (found == expected).all()


@given(st.binary(min_size=0, max_size=400), st.integers(64, 120))
@settings(max_examples=50, deadline=None)
def test_every_string_holds_an_anchor(text, size):
    b = np.frombuffer(text, np.uint8)
    places, _ = repeats.anchors(b, size)
    for at in range(len(b) - size + 1):
        assert ((places >= at) & (places <= at + size - repeats.GRAM)).any()


def test_anchors_across_steps(monkeypatch):
    r = random.Random(1)
    b = np.array([r.randint(97, 100) for _ in range(5000)], np.uint8)
    whole = repeats.anchors(b, 90)
    monkeypatch.setattr(repeats, "STEP", 700)
    parts = repeats.anchors(b, 90)
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))


def test_counts_of_strings_settle_large_groups(spark, hard_dir, monkeypatch):
    docs = spark.read.parquet(f"{hard_dir}/documents.parquet")
    usual = sorted(repeats.repeats(docs).drop("spans").collect())
    monkeypatch.setattr(repeats, "HOT", 1)
    assert sorted(repeats.repeats(docs).drop("spans").collect()) == usual


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40), st.lists(st.sampled_from(["a", "b", "c"]), min_size=13, max_size=20))
@settings(max_examples=60, deadline=None)
def test_a_shared_window_leaves_a_shared_fingerprint(before, span):
    item = winnowing.hashes([w.encode() for w in span])
    doc = winnowing.hashes([w.encode() for w in [*before, *span, "x"]])
    assert set(winnowing.winnowed(item, 5, 13)) & set(winnowing.winnowed(doc, 5, 13))


def test_removing_hits_keeps_the_rest():
    raw = "Ab, cd ef--gh É ij.".encode()
    assert winnowing.words_of(raw) == [b"ab", b"cd", b"ef", b"gh", "É".encode(), b"ij"]
    assert winnowing.without(raw, np.array([0, 1, 1, 0, 1, 0], bool)).decode() == "Ab, --gh  ij."


def test_merges_like_a_plain_loop():
    r = random.Random(2)
    for _ in range(200):
        ranks = {}
        for rank in range(12):
            ranks.setdefault((r.randint(0, 3 + rank), r.randint(0, 3 + rank)), (rank, 4 + rank))
        symbols = [r.randint(0, 3) for _ in range(r.randint(0, 30))]
        plain = list(symbols)
        while pairs := [(ranks[p][0], i) for i, p in enumerate(itertools.pairwise(plain)) if p in ranks]:
            i = min(pairs)[1]
            plain[i : i + 2] = [ranks[plain[i], plain[i + 1]][1]]
        assert bpe_count.merged_count(list(symbols), ranks) == len(plain)


def test_lattice_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b"\0a", b"ab", b"bc", b"abc"]
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces))))
    weight = dict(zip(pieces, np.exp(logp), strict=True))
    lattice = lattice_lm.Lattice(*lattice_lm.piece_table(pieces), logp, 4)

    def total(text):
        return 1.0 if not text else sum(weight[text[:k]] * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in weight)

    words = [b"", b"a", b"abc", b"abcabc", b"xabz", b"c" * 9]
    assert np.allclose(np.exp(lattice.scores(words)), [total(b"\0" + w) for w in words])
    # expected uses: derivative of the log total by each piece's log weight
    times = np.array([1.0, 2, 3, 1, 2, 5])
    uses = lattice.expected(words, times)
    for k in (pieces.index(b"\0a"), pieces.index(b"abc"), pieces.index(b"c")):
        more = logp.copy()
        more[k] += 1e-6
        slope = (times * (lattice_lm.Lattice(lattice.hashes, lattice.numbers, more, 4).scores(words) - lattice.scores(words))).sum() / 1e-6
        assert abs(slope - uses[k]) < 1e-4


def test_a_text_is_the_sum_over_all_its_segmentations(spark, monkeypatch):
    """The whole operator against a recursion over each document's characters."""
    pieces = [b"a", b"b", b"ab", b"\0a", b"\0ab", b"\0", b"bab"]
    first = np.log(np.array([3, 2, 2, 1, 1, 1, 1]) / 11)
    monkeypatch.setattr(lattice_lm, "read_pieces", lambda path: (pieces, first))
    texts = ["ab ab bab", "a b", "", None, "AB abab", "bab ba"]
    held = {1, 4}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in lattice_lm.lattice_scores(df, F.col("doc_id").isin(*held), "", rounds=2, prior=5.0).collect()}
    marked = {d: [b"\0" + w for w in (t or "").lower().encode().split()] for d, t in enumerate(texts)}

    def paths(word):
        return [[]] if not word else [[p, *rest] for p in pieces if word.startswith(p) for rest in paths(word[len(p) :])]

    weight, ends = dict(zip(pieces, np.exp(first), strict=True)), len(texts) - len(held)
    for _ in range(2):
        uses = {p: 5.0 * np.exp(f) for p, f in zip(pieces, first, strict=True)}
        for d in set(marked) - held:
            for w in marked[d]:
                chance = [np.prod([weight[p] for p in path]) for path in paths(w)]
                for path, c in zip(paths(w), chance, strict=True):
                    for p in path:
                        uses[p] += c / sum(chance)
        weight = {p: u / sum(uses.values()) for p, u in uses.items()}
    whole = sum(uses.values()) + ends
    for d, words in marked.items():
        chance = [sum(np.prod([uses[p] / whole for p in path]) for path in paths(w)) for w in words]
        assert found[d] == pytest.approx(np.log10(ends / whole) + sum(np.log10(c) for c in chance), rel=1e-9)


def test_all_pieces_of_the_vocabulary_are_read():
    import public_tokenizers

    pieces, _ = lattice_lm.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) > 16 and len(pieces) > 25_000


def test_long_words_score_in_bounded_chunks():
    pieces = [bytes([b]) for b in range(256)]
    lattice = lattice_lm.Lattice(*lattice_lm.piece_table(pieces), np.full(256, -np.log(256)), 1)
    assert np.allclose(lattice.scores([b"q" * 5000, b"q"]), [-5001 * np.log(256), -2 * np.log(256)])


def test_learning_finds_the_words_that_matter():
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghijklmnop") * 2 for _ in range(60)) + (" idiot" if y else "") for y in [0, 1] * 200]
    held = [(np.r_[0, np.unique(toxicity.features(t.encode()))], y) for t, y in zip(texts, [0, 1] * 200, strict=True)]
    at, w = toxicity.learn(held, 2.0, 1.0, 4.0, 0.0, 5)
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    scores = [sum(weight.get(i, 0) for i in f) for f, _ in held]
    assert min(scores[1::2]) > max(scores[::2]) and len(at) < 100


def test_learning_as_by_one_coordinate_at_a_time():
    r = random.Random(5)
    rows = [(np.unique([0, *(r.randint(1, 30) for _ in range(6))]), r.randint(0, 1)) for _ in range(80)]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.4, 0.1
    z, n = Counter(), Counter()

    def weight(i):
        if i and abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1) * (i > 0)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for at, label in rows:
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    at, w = toxicity.learn(rows, alpha, beta, l1, l2, 3)
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx({i: weight(i) for i in sorted(z) if weight(i) or not i}, rel=1e-9)


def test_sets_of_shingles():
    assert len(minhash.shingle_set(b"", 2)) == 0 and len(minhash.shingle_set(b"A", 2)) == 1
    assert (minhash.shingle_set(b"A b c", 2) == minhash.shingle_set(b" a\nB  c ", 2)).all()
    assert len(minhash.shingle_set(b"a b a b", 2)) == 2


@pytest.mark.parametrize(("text", "n"), [("Xk29fLqP0zRt81mNbVc4Qw", 1), ("aaaaaaaaaaaaaaaaaaaaaaA1", 0), ("password=Xk29fLqP0zRt81mNbVc4Qw", 0)])
def test_generated_looks(text, n):
    assert sum(s[1] == 3 for s in secret_scan.scan(text, 3.5)) == n


def test_an_owner_may_hold_a_credential_in_many_documents(spark):
    key, public = "Xk29fLqP0zRt81mNbVc4Qw", "zQ9mT4rB7xW2kL8vN1pD6s"
    rows = [(i, f"{i} {key}", "a") for i in range(9)] + [(9 + i, public, "ab"[i % 2]) for i in range(4)]
    found = secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()
    spans = {r.doc_id: [(s.kind, s.live, s.docs) for s in r.spans] for r in found}
    assert spans == {i: [(3, True, 9)] if i < 9 else [] for i in range(13)}


def test_redaction(spark):
    from pyspark.sql import functions as F

    df = spark.sql("SELECT 'é token=abcdefghijkl, rest' AS text, array(named_struct('start', 2, 'kind', 0, 'end', 20, 'low', 8, 'live', true), named_struct('start', 9, 'kind', 2, 'end', 12, 'low', 9, 'live', true)) AS spans")
    assert df.select(secret_scan.redacted(F.col("text"), F.col("spans"))).first()[0] == "é token=[secret], rest"


def test_cascade_is_exact_over_its_keys(spark):
    from pyspark.sql import functions as F

    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key LIKE '%7'")
    levels = url_cascade.cascade(listed, universe)
    wrong = universe.where(url_cascade.member(F.col("key"), levels) != F.col("key").like("%7"))
    assert len(levels) > 1 and wrong.count() == 0
    assert sum(len(x[3]) for x in levels) < 300 * 3
