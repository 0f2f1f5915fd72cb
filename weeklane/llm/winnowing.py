"""Benchmark contamination by winnowed fingerprints.

Of each ``window - gram + 1`` consecutive word k-grams the smallest hash is kept. So a span of
``window`` words that a document and an item share leaves one fingerprint that both keep. Items of
fewer words are one fingerprint of their own length, and documents are hashed at those lengths too.
Test fingerprints set bits in a bitmap of fixed size; a document's fingerprints outside it are
dropped early, and the others meet the test fingerprints in a join. Hits are then extended and
confirmed on the words themselves.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weeklane.llm.common import cut, small, text_of
from weeklane.llm.minhash import MIX, mixed, signed

BITS = 22  # of the bitmap: 512 KB, whatever the benchmark's size
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and all that isn't ASCII."""
    return text.translate(TABLE).split()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    x = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        x = x * MIX[0] + h[i : len(h) - k + 1 + i]
    return mixed(x + np.uint64(k * 0x9FB21C651E98DF25 % 2**64))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def winnowed(h: np.ndarray, gram: int, window: int) -> np.ndarray:
    """The smallest k-gram hash of each window of words; repeats in a row once."""
    if len(h) < window:
        return np.zeros(0, np.uint64)
    x, w, step = grams(h, gram), window - gram + 1, 1
    while step < w:  # minima over 2, 4, ... and at last w places
        by = min(step, w - step)
        x = np.minimum(x[: len(x) - by], x[by:])
        step += by
    return x[np.r_[True, x[1:] != x[:-1]]]


def places(words: list[bytes], windows: dict[int, dict[tuple, list]]) -> tuple[np.ndarray, set]:
    """Which words lie inside an occurrence of a window, and whose windows occur."""
    hit, whose = np.zeros(len(words) + 1, np.int64), set()
    for size, of in windows.items():
        for at in range(len(words) - size + 1):
            found = of.get(tuple(words[at : at + size]))
            if found:
                whose.update(found)
                hit[at] += 1
                hit[at + size] -= 1
    return np.cumsum(hit[:-1]) > 0, whose


def item_fingerprints(items: DataFrame, gram: int, window: int) -> DataFrame:
    """(item row, size, fp): size is window, or the words of a shorter item."""

    def run(batches):
        for batch in batches:
            rows, sizes, fps = [], [], []
            for row, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                h = hashes(words_of(text))
                fp = winnowed(h, gram, window) if len(h) >= window else grams(h, len(h)) if len(h) else h
                rows += [row] * len(fp)
                sizes += [min(len(h), window)] * len(fp)
                fps += signed(fp).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64())], ["item", "size", "fp"])

    return items.select("item", "text").mapInArrow(run, "item long, size int, fp long").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", gram: int = 5, window: int = 13) -> DataFrame:
    """Per input row: id, n_words, n_hit, n_items, items (sorted ids as strings), kept_text.

    kept_text is the text with the hit words taken out, null if none is hit. A null text has no
    words. Items without words have no window. Items that repeat an id count once; an item with a
    null id marks words but is not listed. Repeated document rows are judged each for itself.
    """
    own = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    test = cut(items.select(F.col(item_col).cast("string").alias("item_id"), text_of("text").alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    fps = cut(item_fingerprints(test, gram, window), "fingerprints")
    sizes = sorted(r["size"] for r in fps.select("size").distinct().collect())  # at most window values
    bit = F.col("fp").bitwiseAND(F.lit((1 << BITS) - 1))
    set_bits = fps.groupBy(F.shiftright(bit, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).collect()  # at most 2**17 rows
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)
    for r in set_bits:
        bitmap[r["at"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            texts, n, found = batch.column("text").cast(pa.large_binary()).to_pylist(), [], []
            for text in texts:
                h = hashes(words_of(text))
                n.append(len(h))
                own = [winnowed(h, gram, window) if size == window else grams(h, size) for size in sizes if size <= len(h)]
                fp = np.concatenate(own) if own else np.zeros(0, np.uint64)
                low = fp & np.uint64((1 << BITS) - 1)
                fp = fp[(bits[low >> np.uint64(5)] >> (low & np.uint64(31)).astype(np.uint32)) & 1 == 1]
                found.append(np.unique(signed(fp)))
            has = pa.array([len(x) > 0 for x in found])
            text = pa.compute.if_else(has, batch.column("text"), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64())), text], ["row", "doc", "n", "fps", "text"])

    kind = dict(own.dtypes)["doc"]
    seen = cut(own.select("row", "doc", "text").mapInArrow(run, f"row long, doc {kind}, n long, fps array<long>, text string"), "seen")
    met = seen.select("row", F.explode("fps").alias("fp")).join(fps.select("fp", "item").distinct(), "fp").select("row", "item").distinct()
    of = met.join(test, "item").groupBy("row").agg(F.collect_set(F.struct("item_id", "text")).alias("items"))

    def extend(batches):
        for batch in batches:
            out = {"row": [], "n_hit": [], "items": [], "kept_text": []}
            for row, text, its in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True):
                windows: dict = {}
                for it in its:
                    w = words_of(it["text"].encode())
                    size = min(len(w), window)
                    for at in range(len(w) - size + 1):
                        windows.setdefault(size, {}).setdefault(tuple(w[at : at + size]), []).append(it["item_id"])
                raw = text.encode()
                hit, whose = places(words_of(raw), windows)
                out["row"].append(row)
                out["n_hit"].append(int(hit.sum()))
                out["items"].append(sorted(x for x in whose if x is not None))
                out["kept_text"].append(without(raw, hit).decode() if hit.any() else None)
            yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["kept_text"], pa.string())], list(out))

    near = cut(seen.where(F.size("fps") > 0).select("row", "text").join(of, "row").mapInArrow(extend, "row long, n_hit long, items array<string>, kept_text string"), "hits")
    return seen.select("row", "doc", "n").join(near, "row", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "kept_text",
    )


def without(raw: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words; each run of hit words goes with what stands inside the run."""
    plain = raw.translate(TABLE)
    out, at, word = [], 0, 0
    gap = 0
    for part in plain.split(b" "):
        if part:
            if hit[word]:
                out.append(raw[at:gap] if not (word and hit[word - 1]) else b"")
                at = gap + len(part)
            word += 1
        gap += len(part) + 1
    out.append(raw[at:])
    return b"".join(out)


def sha(items: str = "items"):
    return F.sha2(F.concat_ws(",", items), 256)


