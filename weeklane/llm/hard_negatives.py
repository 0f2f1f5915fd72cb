"""Hard negatives by a vertical scan of bounded partial scores (BOND).

The rows are kept in blocks of a few labels each, and a block's vectors by columns. An anchor reads
the columns of a block in the order of its own components' size, largest first, and adds up partial
inner products. What the unread columns can still add lies between sums of their least and greatest
products, from each column's least and greatest value; after every few columns the bitmap of
candidates loses those that can no longer count. The last ones standing are scored exactly, all in
whole numbers.

Two such scans run: the first finds the nearest rows of the anchor's own label (its positives), and
reads only blocks that hold this label; the second finds, per positive, the best rows of other labels
whose scores lie in a window that the positive's score sets. In the second, a candidate goes when it
can reach no window, or when a window surely holds enough better ones.

Anchors are dealt in parts, and each part meets each block once: memory is bounded by one block and
one part, and no two rows of the table are paired but an anchor with a row. Blocks are cut from rows
sorted by label and row number, so that a label with a third of all rows fills blocks of the same size
as any other.

Rows take no part if their label or vector is null, if the vector holds null, NaN or infinite
components, or isn't of the length that most vectors have. Repeated ids are rows of their own, as
candidates and as anchors; ties go to the smaller id (null last), then to the row that was read
first. Components beyond 2**53 count as 2**53, scores beyond 64 bits as the largest. Empty tables
and anchors without positives or without rows in a window give no rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weeklane.llm.common import cut, small
from weeklane.llm.vectors import common_length, finite, matrix

CELLS = 1 << 22  # of a block's columns
LEAST_BLOCKS = 24  # blocks of a table, so that small ones keep several tasks busy
ANCHORS = 4_096  # of a part
STRIDE = 8  # columns read between two looks at the bitmap
SPANS = 1_000_000  # rows of (block, label) that may be broadcast
FAR = float(1 << 53)
LAST = (1 << 63) - 1


class Block:
    """The vectors of some rows by columns, with each column's span, and their order under ties."""

    def __init__(self, held: pa.Table, dim: int, far: int):
        x = matrix(held["x"], dim, np.int64)
        bound = int(np.abs(x).max(initial=0)) * far * dim
        self.kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object  # sums are exact in each
        self.columns = np.ascontiguousarray(x.T.astype(self.kind))
        self.least, self.greatest = self.columns.min(1), self.columns.max(1)
        order = pc.sort_indices(held.select(["id", "row"]), sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end")
        self.tie = np.empty(len(x), np.int64)
        self.tie[order.to_numpy()] = np.arange(len(x))
        self.held, self.same = held, {}

    def of_label(self, label: pa.Scalar) -> np.ndarray:
        key = label.as_py()
        if key not in self.same:
            self.same[key] = pc.equal(self.held["label"], label).to_numpy()
        return self.same[key]

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of those that keep(lower, upper) leaves after every stride."""
        a = anchor.astype(self.kind)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([a * self.least, a * self.greatest])
        low, high = (np.append(np.cumsum(f(ends, axis=0)[order][::-1])[::-1], 0) for f in (np.min, np.max))
        part = np.zeros(len(alive), self.kind)
        for at in range(0, len(order), STRIDE):
            read = order[at : at + STRIDE]
            part = part + a[read] @ self.columns[np.ix_(read, alive)]
            at += len(read)
            left = keep(part + low[at], part + high[at])
            if not left.all():
                alive, part = alive[left], part[left]
            if not len(alive):
                break
        return alive, part

    def best(self, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.tie[places], -scores))[:k]


def nth(values: np.ndarray, k: int):
    """The kth largest, None if there are fewer."""
    if len(values) < k:
        return None
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[-k]


def among_best(k: int):
    def keep(lower, upper):
        least = nth(lower, k)
        return upper >= least if least is not None else np.ones(len(lower), bool)

    return keep


def in_windows(windows: list[tuple[int, int]], k: int):
    def keep(lower, upper):
        out = np.zeros(len(lower), bool)
        for first, last in windows:
            can = (upper >= first) & (lower <= last)
            least = nth(lower[(lower >= first) & (upper <= last)], k)
            out |= can & (upper >= least) if least is not None else can
        return out

    return keep


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def dealt(items: DataFrame, anchors: DataFrame, dim: int, find) -> DataFrame:
    """(row, k, id, other, score) of what find(block, anchor, its row in asked) yields as (k, places, scores).

    Items and anchors meet by (block, part), the anchors' part and each of its blocks.
    """
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("k", T.IntegerType()), items.schema["id"], T.StructField("other", T.LongType()), T.StructField("score", T.LongType())])

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        at, ks, places, scores = [], [], [], []
        if held.num_rows and asked.num_rows:
            held, asked = held.combine_chunks(), asked.combine_chunks()
            x = matrix(asked["x"], dim, np.int64)
            block = Block(held, dim, int(np.abs(x).max()))
            for i in range(len(x)):
                for k, p, s in find(block, x[i], {c: asked[c][i] for c in asked.column_names if c != "x"}):
                    at += [i] * len(p)
                    ks += [k] * len(p)
                    places += p.tolist()
                    scores += [max(-LAST, min(LAST, int(v))) for v in s]
        own = pa.array(places, pa.int64())
        return pa.table([asked["row"].take(pa.array(at, pa.int64())), pa.array(ks, pa.int32()), held["id"].take(own), held["row"].take(own), pa.array(scores, pa.int64())], schema.names)

    return items.groupBy("block", "part").cogroup(anchors.groupBy("block", "part")).applyInArrow(run, schema)


def first(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """rank and the first n rows of each group by falling score; each cell has sent n at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mined(
    df: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: condition over df's columns. label: the label to use, that of label_col if not given. A
    negative's score lies between low and high hundredths of the positive's.
    """
    id_type = df.schema[id_col].dataType
    scaled = F.transform(F.col(vec_col), lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(FAR)), F.lit(-FAR))))
    label = F.col(label_col) if label is None else label
    rows = df.where(finite(F.col(vec_col))).select(F.col(id_col).alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), scaled.alias("x")).where("label is not null")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    dim = common_length(rows, "x")
    if not dim:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(c, t) for c, t in (("anchor_id", id_type), ("positive_id", id_type), ("rank", T.IntegerType()), ("negative_id", id_type), ("positive_score", T.LongType()), ("negative_score", T.LongType()))]))
    rows = rows.where(F.size("x") == dim)
    counted = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    size = max(1, min(CELLS // dim, -(-counted["n"] // LEAST_BLOCKS)))
    parts = max(1, -(-counted["a"] // ANCHORS))
    items = cut(rows.repartitionByRange(-(-counted["n"] // size), "label", "row").withColumn("block", F.spark_partition_id()), "blocks")
    spans = cut(items.select("block", "label").distinct(), "spans")
    last = spans.agg(F.max("block").alias("b")).first()["b"]
    anchors = items.where("anchor").select("row", "id", "label", "x", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).toDF("row", "id", "label", "x", "part")
    held = items.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "row", "id", "label", "x")

    def own_label(block: Block, a: np.ndarray, asked: dict):
        alive = np.flatnonzero(block.of_label(asked["label"]) & (block.held["row"].to_numpy() != asked["row"].as_py()))
        p, s = block.scan(a, alive, among_best(positives))
        top = block.best(p, s, positives)
        yield 0, p[top], s[top]

    near = dealt(held, anchors.select("row", "label", "x", "part").join(small(spans, SPANS), "label"), dim, own_label)
    near = cut(first(near, ["row"], positives).select("row", F.col("rank").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    asked = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", F.col("positive_score").alias("score")))).alias("positives"))  # few to an anchor

    def other_label(block: Block, a: np.ndarray, asked: dict):
        windows = {p["k"]: window(p["score"], low, high) for p in asked["positives"].as_py()}
        alive = np.flatnonzero(~block.of_label(asked["label"]))
        p, s = block.scan(a, alive, in_windows([w for w in set(windows.values()) if w[0] <= w[1]], negatives))
        for k, (least, most) in windows.items():
            inside = np.flatnonzero((s >= least) & (s <= most))
            top = inside[block.best(p[inside], s[inside], negatives)]
            yield k, p[top], s[top]

    every = anchors.select("row", "label", "x", "part").join(asked, "row").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    found = first(dealt(held, every, dim, other_label), ["row", "k"], negatives)
    found = found.select("row", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["row", "k"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
