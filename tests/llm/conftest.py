import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the of and lake stone river under cloud winter glass paper seven quiet market yellow garden".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "er", "ing", "s"]) + str(r.randint(0, 30)) * (r.random() < 0.5) for _ in range(n))


def write(path, name, columns):
    pq.write_table(pa.table(columns), f"{path}/{name}.parquet")


@pytest.fixture(scope="session")
def hard_dir(tmp_path_factory):
    """Documents with nulls, blanks, copies, near copies, long texts, odd characters, ties and
    repeated rows; extra columns have names that the operators use themselves."""
    r, path = random.Random(5), tmp_path_factory.mktemp("hard")
    base, long = prose(r, 120), prose(r, 30_000)
    passage = prose(r, 90)
    item = prose(r, 30)
    texts = [None, "", " \t\n", "one", "one two", "ONE two", base, base, base.upper(), base + " tail", base.replace("the", "a", 1), long, long + " more",
             prose(r, 50) + passage + prose(r, 40), prose(r, 70) + "\n" + passage, passage, "x" * 900, "y" * 399, "z" * 400, "ab" * 600,
             "É\u00a0é \x1c\x85 ſecret=K\u212aey é" * 3, "password = 'abcdefghijkl' token:short password=token:abcdefghijkl AKIA" + "Q7" * 9 + " " + "deadbeef" * 4 + " " + "0f" * 9,
             "API_key:'AbC123+/=_.-xyzq' \U0001f600 secret==abcdefghijklmnop akia" + "A" * 20 + " 12345678901234567", "Xk29fLqP0zRt81mNbVc4Qw and zQ9mT4rB7xW2kL8vN1pD6s", "copy Xk29fLqP0zRt81mNbVc4Qw",
             "<|endoftext|> it's  we'LL 'll\r\n\r\n123abc\u0660", prose(r, 20) + " " + item, item.upper().replace(" ", "--"), "alpha beta", "Alpha,beta gamma", prose(r, 200), prose(r, 200), prose(r, 5)]
    texts += [prose(r, r.randint(1, 300)) for _ in range(40)]
    ids = list(range(len(texts)))
    sources = [None if i % 11 == 0 else ["a", "b", "é", "Z", ""][i % 5] if i % 3 else "hot" for i in ids]
    extra = {k: pa.array([str(i) for i in ids]) for k in ("row", "doc", "h", "n", "at", "size", "node", "score", "owner", "word", "taken", "_text_to_score2", "comp")}
    write(path, "documents", {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), **extra})
    write(path, "benchmark", {"item_id": pa.array([0, 1, 2, 3, 4, 5, 5], pa.int64()), "text": pa.array([item, None, "", "alpha BETA", prose(r, 13), "--", item], pa.string()), "fp": ["x"] * 7})
    write(path, "labels", {"doc_id": pa.array([*ids, *ids[:5]], pa.int64()), "quality": pa.array([1] * (len(ids) + 5), pa.int32()), "toxic": pa.array([None if i % 13 == 5 else int(i % 4 == 0) for i in [*ids, *ids[:5]]], pa.int32())})
    urls = [None, "", "no scheme", "http://", "http://a.example.com/en/1", "http://www.example.com/en/", "http://x.www.EXAMPLE.com/en/x?y#z", "https://example.com", "https://example.com/fr/", "ftp://é.net/fr/a", "http://net/es/", "http://net/es", "http://notnet/es/",
            "http://.net/fr/", "http://a.net./fr/", "http://example.com.evil.org/en/", "http://myexample.com/en/", "x://y://example.com/en/", "http://com/", "http://com?/en/", "http://Foo.COM#/", "http://u@example.com:80/en/", "http://example.com:80/en/"]
    write(path, "pages", {"page_id": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls, pa.string()), "html": ["x"] * len(urls), "host": ["h"] * len(urls), "key": ["k"] * len(urls)})
    vectors = [None, [], [0.0] * 6, [1.0, None, 0, 0, 0, 0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1.0, 2.0]]
    vectors += [[r.gauss(0, 1) * (1 + i % 3) for _ in range(6)] for i in range(180)] + [[1.0, 0, 0, 0, 0, 0]] * 40
    write(path, "embeddings", {"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32()), "node": ["n"] * len(vectors)})
    return str(path)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, hard_dir):
    path = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "labels", "pages", "embeddings"):
        pq.write_table(pq.read_table(f"{hard_dir}/{name}.parquet").slice(0, 0), f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="session")
def hard_docs(hard_dir):
    t = pq.read_table(f"{hard_dir}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
