"""Repeated byte strings, found column by column over many aligned contexts.

Every string of ``size`` bytes holds, at a place that its bytes alone decide, the smallest hash of
its byte k-grams: its anchor. So two equal strings have equal anchors at equal places, and only
contexts around equal anchors need to be compared. These contexts, aligned at their anchors, are
the documents of a column-wise construction: each round inserts the next column, one byte per
context, into the collection's order by reversed prefix (its positional Burrows-Wheeler transform)
and updates the lengths that neighbours in that order have in common. A string ending in a column
occurs twice if a neighbour shares ``size`` bytes. Contexts that are equal in all their bytes are
counted first and go in once, and texts that are equal go in once, so that copies cost nothing.

The construction over whole texts, one byte of each text per round against one external file of the
whole collection, needs as many passes over the file as the longest text has bytes (see README);
contexts bound both the rounds and the file.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weeklane.llm.common import cut, text_of
from weeklane.llm.minhash import MIX, mixed, signed

GRAM = 64  # bytes of an anchor; short ones are shared by chance
DOUBLED = (1, 2, 4, 8, 16, 32)
ROUND = 8_000  # contexts in one construction, or one group of equal anchors
HOT = 50_000  # a larger group is settled by counting its strings' hashes
STEP = 1 << 20  # bytes of a text that are hashed at once


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Mixed hashes of all GRAM-byte strings of b."""
    x = b.astype(np.uint64) + np.uint64(1)
    x = mixed(x * MIX[0])
    for k in DOUBLED:
        x = x[:-k] * MIX[k % 3] * np.uint64(2 * k + 1) + (x[k:] ^ (x[k:] >> np.uint64(31)))
    return mixed(x)


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    step = 1
    while step < w:
        by = min(step, w - step)
        x = np.minimum(x[: len(x) - by], x[by:])
        step += by
    return x


def anchors(b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of the size-byte strings of b; ties go to the first place."""
    if len(b) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes, last = [], [], -1
    low_bits = np.uint64(0xFFFFFF)  # a place in a step fits; the other bits are the hash's
    for at in range(0, len(b) - size + 1, STEP):
        h = gram_hashes(b[at : at + STEP + size - 1])
        low = window_minima(h & ~low_bits | np.arange(len(h), dtype=np.uint64), size - GRAM + 1)
        place = (low[np.r_[True, low[1:] != low[:-1]]] & low_bits).astype(np.int64)
        place = place[place + at > last]
        places.append(place + at)
        hashes.append(h[place])
        last = int(places[-1][-1]) if len(place) else last
    return np.concatenate(places), np.concatenate(hashes)


def covered(cells: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Which bytes of each context lie in a size-byte string that another context of the group has
    in the same columns. Rows of a group stand together; columns low to high of a row are its text.

    order is the rows by group, then reversed prefix; since[i] is the first column from which the
    rows order[i - 1] and order[i] agree up to the current one.
    """
    n, width = cells.shape
    order, since = np.arange(n), np.zeros(n + 1, np.int64)
    new = np.r_[True, group[1:] != group[:-1]]
    start, rank = np.flatnonzero(new), np.cumsum(new) - 1
    never = width + 1  # nothing in common across groups, which keep their places
    since[start] = since[n] = never
    marks = np.zeros((n, width + 1), np.int32)
    for col in range(width):
        key = rank * 512 + cells[order, col]
        if (key[1:] < key[:-1]).any():
            moved = np.argsort(key, kind="stable")
            fresh = np.r_[since[moved], never]
            key = key[moved]
            back = np.flatnonzero((moved[1:] != moved[:-1] + 1) & (key[1:] == key[:-1])) + 1  # new neighbours of the same symbol
            if len(back):  # they agree as far as all rows that stood between them
                between = np.stack([moved[back - 1] + 1, moved[back] + 1], 1).ravel()
                fresh[back] = np.maximum.reduceat(since, between)[::2]
            order, since = order[moved], fresh
        since[np.flatnonzero(key[1:] != key[:-1]) + 1] = col + 1
        since[start] = never
        if col >= size - 1:
            first = col - size + 1
            twin = since <= first
            rows = order[twin[:-1] | twin[1:]]
            rows = rows[(low[rows] <= first) & (high[rows] > col)]
            marks[rows, first] += 1
            marks[rows, col + 1] -= 1
    return np.cumsum(marks, axis=1)[:, :width] > 0


def runs(cover: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def anchored(texts: DataFrame, size: int) -> DataFrame:
    """(h1, h2, n, at, anchor, around): a text's key and bytes, each anchor and its context's hash."""

    def run(batches):
        reach = size - GRAM
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("h1", "h2")]
            which, ats, hashes, around, lengths = [], [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                at, h = anchors(np.frombuffer(text, np.uint8), size)
                which.append(np.full(len(at), i))
                ats.append(at)
                hashes.append(h)
                lengths.append(np.full(len(at), len(text)))
                around += [xxhash.xxh3_64_intdigest(text[max(p - reach, 0) : p + size], min(p, reach)) - (1 << 63) for p in at.tolist()]
            i = np.concatenate(which) if which else np.zeros(0, np.int64)
            at, h, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ats, hashes, lengths))
            cols = [pa.array(keys[0][i]), pa.array(keys[1][i]), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(signed(h)), pa.array(around, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "n", "at", "anchor", "around"])

    return texts.select("h1", "h2", "text").mapInArrow(run, "h1 long, h2 long, n int, at int, anchor long, around long")


def contexts(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(anchor, h1, h2, at, lead, context): the bytes, lead of them before the anchor."""

    def run(batches):
        reach = size - GRAM
        for batch in batches:
            rows = []
            for h1, h2, text, places in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("list").to_pylist(), strict=True):
                for p in places:
                    low = max(0, p["at"] - reach)
                    rows.append((p["anchor"], h1, h2, p["at"], p["at"] - low, text[low : p["at"] + size]))
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    def batch_of(rows):
        kinds = {"anchor": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "at": pa.int32(), "lead": pa.int32(), "context": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))

    lists = cut(wanted.groupBy("h1", "h2").agg(F.collect_list(F.struct("at", "anchor")).alias("list")), "wanted")
    found = texts.join(lists, ["h1", "h2"]).select("h1", "h2", "text", "list").mapInArrow(run, "anchor long, h1 long, h2 long, at int, lead int, context binary")
    return found


def column_wise(found: DataFrame, size: int) -> DataFrame:
    """(h1, h2, low, high) of repeated strings, from the groups of equal anchors."""

    def spans(rows):
        reach, width = size - GRAM, 2 * size - GRAM
        cells = np.full((len(rows), width), 256, np.uint16)
        low = np.array([reach - r[4] for r in rows])
        high = np.array([reach - r[4] + len(r[5]) for r in rows])
        for i, r in enumerate(rows):
            cells[i, low[i] : high[i]] = np.frombuffer(r[5], np.uint8)
        cover = covered(cells, np.array([r[0] for r in rows]), low, high, size)
        some = np.flatnonzero(cover.any(axis=1))
        out = [(*rows[i][1:3], rows[i][3] - reach + a, rows[i][3] - reach + b) for i in some for a, b in runs(cover[i])]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["h1", "h2", "low", "high"])

    def run(batches):
        rows: list = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "h1", "h2", "at", "lead", "context")), strict=True):
                if rows and rows[-1][:4] == r[:4]:
                    continue  # another copy of the text
                if len(rows) >= ROUND and rows[-1][0] != r[0]:
                    yield spans(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield spans(rows)

    dealt = found.repartition(F.col("anchor")).sortWithinPartitions("anchor", "h1", "h2", "at")
    return dealt.mapInArrow(run, "h1 long, h2 long, low int, high int")


def by_counts(found: DataFrame, size: int) -> DataFrame:
    """As column_wise, for groups of any size: equal strings are counted by their hash."""

    def run(batches):
        for batch in batches:
            for anchor, h1, h2, at, lead, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "h1", "h2", "at", "lead", "context")), strict=True):
                n = max(0, len(text) - size + 1)
                key = [xxhash.xxh3_64_intdigest(text[i : i + size], (anchor + i - lead) % (1 << 64)) - (1 << 63) for i in range(n)]
                start = np.arange(at - lead, at - lead + n)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.full(n, h1)), pa.array(np.full(n, h2)), pa.array(start, pa.int32())], ["key", "h1", "h2", "low"])

    each = found.dropDuplicates(["anchor", "h1", "h2", "at"]).mapInArrow(run, "key long, h1 long, h2 long, low int")
    twice = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return each.join(twice, "key").select("h1", "h2", "low", (F.col("low") + size).alias("high"))


def repeats(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of low and high, in
    bytes) and, with texts, kept (the remaining bytes).

    A byte goes if a string of size bytes over it starts anywhere else too. Matches don't cross
    texts; a null text is empty; rows that repeat a text of at least size bytes lose all of it. size
    must be at least GRAM.
    """
    if size < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes are needed")
    own = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    own = own.select("doc", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(size), "text").alias("h2"), F.octet_length("text").alias("n"), "text")  # equal texts have equal keys
    copies = own.where(F.col("n") >= size).groupBy("h1", "h2", "n").agg(F.count("*").alias("k")).where("k > 1")

    found = cut(anchored(own.where(F.col("n") >= size), size), "anchors")
    shared = found.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    twice = cut(found.join(shared, "anchor").withColumn("place", F.xxhash64("h1", "h2", "at")), "repeated")
    first = [F.min_by(c, "place").alias(c) for c in ("h1", "h2", "at")]
    kinds = cut(twice.groupBy("anchor", "around").agg(*first, (F.min("place") != F.max("place")).alias("many")), "contexts")
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_ = cut(kinds.join(groups, "anchor").select("h1", "h2", "at", "anchor", "kinds"), "open")
    low, high = F.greatest(F.col("at") - (size - GRAM), F.lit(0)), F.least(F.col("at") + size, F.col("n"))
    whole = twice.join(kinds.where("many").select("anchor", "around"), ["anchor", "around"]).select("h1", "h2", low.alias("low"), high.alias("high")).distinct()
    spans = whole.union(copies.select("h1", "h2", F.lit(0).alias("low"), F.col("n").alias("high")))
    spans = spans.union(column_wise(contexts(own, open_.where(F.col("kinds") <= HOT), size), size))
    hot = open_.where(F.col("kinds") > HOT)
    if not hot.isEmpty():
        spans = spans.union(by_counts(contexts(own, hot, size), size))
    lists = cut(spans.distinct().groupBy("h1", "h2").agg(F.collect_list(F.struct("low", "high")).alias("list")), "spans")

    def run(batches):
        for batch in batches:
            out = {"n_removed": [], "n_spans": [], "kept_sha256": [], "spans": [], "kept": []}
            for text, of in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("list").to_pylist(), strict=True):
                gone = joined([(s["low"], s["high"]) for s in of or []])
                edges = [0, *(x for s in gone for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else text
                for k, x in zip(out, (sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(), [{"low": a, "high": b} for a, b in gone], kept if texts else None), strict=True):
                    out[k].append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])), pa.binary())
            cols = [batch.column("doc"), pc.cast(batch.column("n"), pa.int64())] + [pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "n_bytes", *out])

    kind = dict(own.dtypes)["doc"]
    done = own.join(lists, ["h1", "h2"], "left").select("doc", "n", "text", "list").mapInArrow(run, f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low:int,high:int>>, kept binary")
    return done.withColumnRenamed("doc", id_col) if texts else done.withColumnRenamed("doc", id_col).drop("kept")
