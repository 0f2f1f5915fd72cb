"""Near copies by MinHash with tensored banding.

Two small collections of band hashes, A and B, of ``side`` bands each with ``rows`` minhashes per
band, are computed for a document. Each of the ``side * side`` tables uses the pair (A[i], B[j]) as
its key. So 2 * side * rows minhashes serve side**2 tables of 2 * rows minhashes each, instead of
side**2 * 2 * rows. A pair of similarity s meets with probability (1 - (1 - s**rows)**side)**2:
with side=10 and rows=3, 0.9985 at s=0.80, 0.9993 at 0.82, 0.9998 at 0.85 and over 0.99999 at 0.90.

Candidates are confirmed on the full shingle sets. Documents with equal sets are one node. Nodes
are first tied to a centre of their buckets. Then only buckets that still hold more than one
component are looked at, and of their pairs only those that an exact filter can't rule out, so that
a large group of near copies does not make all its pairs.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weeklane.llm.common import components, cut, small, text_of

WORDS = 4  # of the bitmap of what a node lacks
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` lower-cased words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    x = h[: n - size + 1].copy()
    for k in range(1, size):
        x = x * MIX[0] + h[k : n - size + 1 + k]
    return np.unique(mixed(x))


def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * MIX[1]) | np.uint64(1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, shingle: int, side: int, rows: int) -> DataFrame:
    """A row per document: its set's size and 128-bit hash, and the band hashes a and b."""

    def run(batches):
        mult = multipliers(2 * side * rows)[:, None]
        for batch in batches:
            out = {"n": [], "s1": [], "s2": [], "a": [], "b": []}
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                x = shingle_set(text, shingle)
                out["n"].append(len(x))
                d = xxhash.xxh3_128_digest(x.tobytes())
                out["s1"].append(int.from_bytes(d[:8], "little", signed=True))
                out["s2"].append(int.from_bytes(d[8:], "little", signed=True))
                if not len(x):
                    out["a"].append([])
                    out["b"].append([])
                    continue
                low = (x[None, :16384] * mult).min(axis=1)
                for at in range(16384, len(x), 16384):
                    low = np.minimum(low, (x[None, at : at + 16384] * mult).min(axis=1))
                low = low.reshape(2 * side, rows)
                key = low[:, 0].copy()
                for k in range(1, rows):
                    key = mixed(key) * MIX[0] + low[:, k]
                key = signed(mixed(key))
                out["a"].append(key[:side])
                out["b"].append(key[side:])
            kinds = {"n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "a": pa.list_(pa.int64()), "b": pa.list_(pa.int64())}
            cols = [batch.column("row"), batch.column("doc"), batch.column("h")] + [pa.array(out[k], kinds[k]) for k in kinds]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc", "h", *kinds])

    return docs.mapInArrow(run, "row long, doc long, h long, n long, s1 long, s2 long, a array<long>, b array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(node, n, shingles) of the nodes in ids (row), from whole texts."""

    def run(batches):
        for batch in batches:
            sets = [signed(shingle_set(t, shingle)) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            size = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), size, pa.array(sets, pa.list_(pa.int64()))], ["node", "n", "shingles"])

    need = cut(nodes.join(ids, "row").select(F.col("row").alias("node"), "h"), "need")
    found = docs.join(small(need, 500_000), "h").select("node", "text").dropDuplicates(["node"])
    return cut(found.mapInArrow(run, "node long, n long, shingles array<long>"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets' Jaccard similarity is at least percent / 100."""
    x = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("shingles").alias("y"))
    inter = F.size(F.array_intersect("x", "y"))
    near = F.lit(100) * F.least("nu", "nv") >= F.lit(percent) * F.greatest("nu", "nv")  # no pair beyond it can reach the limit
    return cut(pairs.join(x, "u").join(y, "v").where(near).where(F.lit(100) * inter >= F.lit(percent) * (F.col("nu") + F.col("nv") - inter)).select("u", "v"), "links")


def star_pairs(member: DataFrame) -> DataFrame:
    """(u, v): each node with the centre of one of its buckets.

    The centre is the node whose own buckets hold most nodes: of a family of near copies it is one
    that is close to the others. member: key, row, c (nodes of the bucket).
    """
    central = member.groupBy("row").agg(F.sum("c").alias("reach"))
    order = -F.col("reach") * (1 << 20) + F.pmod(F.xxhash64("row"), F.lit(1 << 20))
    central = cut(central.select("row", order.alias("order")), "central")
    ordered = member.select("key", "row").join(central, "row")
    centre = ordered.groupBy("key").agg(F.min("order").alias("first"))
    best = ordered.join(centre, "key").where("order <> first").groupBy("row").agg(F.min("first").alias("first"))
    return best.join(central.select(F.col("order").alias("first"), F.col("row").alias("v")), "first").select(F.col("row").alias("u"), "v").where("u <> v")


def bitmap(tokens: str, word: int):
    """A 64-bit word of a bitmap of WORDS words in which each of the hashes has a place."""
    place = f"pmod(t, {64 * WORDS})"
    return F.expr(f"aggregate(filter({tokens}, t -> {place} div 64 = {word}), 0L, (b, t) -> b | shiftleft(1L, CAST({place} % 64 AS INT)))")


def open_pairs(rest: DataFrame, sets: DataFrame, percent: int, rare: int) -> DataFrame:
    """Pairs of different components that may reach the limit, by the prefix filter, which is exact.

    Shingles are put in the order of how many nodes hold them. Two sets that reach the limit share a
    shingle among the first n - ceil(percent * n / 100) + 1 of both. If their first shared one is
    held by at most ``rare`` nodes, the pair meets on it. Otherwise all that they share is common,
    and they can share no more than either has of common shingles; so a node with too few of them
    for the smallest partner in its bucket is out. The others meet under the centre of their bucket,
    if the limit can be reached: of the centre's common shingles two nodes share all but those that
    either lacks, and those that both lack are at most the bits that both have set in bitmaps
    of what they lack, and what had no bit of its own. (Two nodes that lack so little that they
    reach the limit anyway are both linked to the centre, so they are one component already.)
    rest: key, row, comp, of the buckets that hold more than one component.
    """
    comp = rest.select("row", "comp").distinct()
    token = sets.select(F.col("node").alias("row"), "n", F.explode("shingles").alias("token"))
    held = token.groupBy("token").agg(F.count("*").alias("df"))
    token = cut(token.join(held, "token"), "tokens")
    place = F.row_number().over(Window.partitionBy("row").orderBy("df", "token"))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = token.withColumn("place", place).where((F.col("place") <= reach) & F.col("df").between(2, rare)).join(comp, "row").select("row", "n", "token", "comp")
    a = first.select("token", F.col("row").alias("u"), F.col("n").alias("nu"), F.col("comp").alias("cu"))
    b = first.select("token", F.col("row").alias("v"), F.col("n").alias("nv"), F.col("comp").alias("cv"))
    sized = F.lit(100) * F.least("nu", "nv") >= F.lit(percent) * F.greatest("nu", "nv")
    by_rare = a.join(b, "token").where((F.col("cu") < F.col("cv")) & sized).select("u", "v")

    common = token.groupBy("row", "n").agg(F.count_if(F.col("df") > rare).alias("o")).where(F.col("n") - F.col("o") < reach)
    left = rest.join(common, "row").withColumn("least", F.min("n").over(Window.partitionBy("key")))
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    left = left.where((100 + percent) * F.col("o") >= percent * (F.col("n") + partner))
    still = left.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    left = cut(left.join(still, "key").select("key", "row", "comp", "n"), "left")

    # a bucket's nodes against its centre: common shingles inside it (p) and outside it (q)
    reach_ = left.groupBy("row").agg(F.count("*").alias("keys")).select("row", (-F.col("keys") * (1 << 20) + F.pmod(F.xxhash64("row"), F.lit(1 << 20))).alias("order"))
    centre = left.select("key", "row").join(reach_, "row").groupBy("key").agg(F.min("order").alias("order")).join(reach_.withColumnRenamed("row", "c"), "order").select("key", "c")
    placed = left.join(centre, "key").select("c", "row", "comp", "n").distinct()
    shared = token.where(F.col("df") > rare).join(left.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.collect_list("token").alias("common"))
    both = placed.join(shared, "row").join(shared.select(F.col("row").alias("c"), F.col("common").alias("core")), "c")
    lacks = both.withColumn("lacks", F.array_except("core", "common"))
    bits = [bitmap("lacks", k) for k in range(WORDS)]
    own = F.size("core") - F.size("lacks")
    placed = lacks.select("c", "row", "comp", "n", F.size("core").alias("core"), F.size("lacks").alias("m"), (F.size("common") - own).alias("q"), *[x.alias(f"b{k}_") for k, x in enumerate(bits)])
    spare = F.col("m") - sum((F.bit_count(f"b{k}_") for k in range(WORDS)), F.lit(0))
    placed = cut(placed.withColumn("s", spare), "placed")
    columns = ("n", "comp", "m", "q", "s", *(f"b{k}_" for k in range(WORDS)))
    a = placed.select("c", "core", *[F.col(x).alias(f"{x}u") for x in columns], F.col("row").alias("u"))
    b = placed.select("c", *[F.col(x).alias(f"{x}v") for x in columns], F.col("row").alias("v"))
    sized = F.lit(100) * F.least("nu", "nv") >= F.lit(percent) * F.greatest("nu", "nv")
    lacked = sum((F.bit_count(F.col(f"b{k}_u").bitwiseAND(F.col(f"b{k}_v"))) for k in range(WORDS)), F.least("su", "sv"))
    share = F.col("core") - F.col("mu") - F.col("mv") + F.least(lacked, "mu", "mv") + F.least("qu", "qv")
    by_centre = a.join(b, "c").where((F.col("compu") < F.col("compv")) & sized & ((100 + percent) * share >= percent * (F.col("nu") + F.col("nv")))).select("u", "v")
    return cut(by_rare.union(by_centre).distinct(), "pairs")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, side: int = 10, rows: int = 3, rare: int = 50) -> DataFrame:
    """docs' ids with n_shingles, component_id and keeper, one row per input row.

    component_id is the smallest id among the documents reachable over links; keeper is true for
    exactly one row of each component (smallest id, then first row). A null text is empty; empty
    texts have no shingles and stay alone. A row with a null id takes part; a component of such
    rows alone has a null component_id. Repeated rows are documents of their own. The id must be
    a whole number. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text", "doc"))
    sig = cut(signatures(own.withColumn("row", F.monotonically_increasing_id()).select("row", "doc", "h", "text"), shingle, side, rows), "signatures")

    # documents with equal sets are one node, named by its first row
    classes = cut(sig.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("node")), "classes")
    nodes = sig.join(classes.select(F.col("node").alias("row")), "row", "left_semi")

    keys = nodes.select("row", F.posexplode("a").alias("i", "ka"), "b").select("row", "i", "ka", F.posexplode("b").alias("j", "kb")).select("row", F.xxhash64("i", "j", "ka", "kb").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    member = cut(keys.join(shared, "key"), "buckets")

    pairs = cut(star_pairs(member).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    links = confirmed(pairs, full_sets(own, nodes, ids_in(pairs), shingle), percent)
    comp = labelled(nodes, components(links))
    tied = member.select("key", "row").join(comp, "row")
    mixed_ = tied.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rest = cut(tied.join(mixed_, "key"), "rest")
    sets = full_sets(own, nodes, rest.select("row").distinct(), shingle)
    more = confirmed(open_pairs(rest, sets, percent, rare), sets, percent)
    if not more.isEmpty():
        comp = labelled(nodes, components(links.union(more)))

    placed = sig.join(classes, ["s1", "s2", "n"], "left").join(comp.withColumnRenamed("row", "node"), "node", "left")
    placed = cut(placed.select("row", "doc", F.col("n").alias("n_shingles"), F.coalesce("comp", "row").alias("comp")), "placed")
    least = placed.groupBy("comp").agg(F.min("doc").alias("component_id"))
    first = placed.join(least, "comp").where("doc <=> component_id").groupBy("comp").agg(F.min("row").alias("first"))
    return (
        placed.join(least, "comp").join(first, "comp")
        .select(F.col("doc").alias(id_col), "n_shingles", "component_id", (F.col("row") == F.col("first")).alias("keeper"))
    )


def ids_in(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("row")).union(pairs.select(F.col("v").alias("row"))).distinct()


def labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(row, comp) of all nodes; a node without links is its own component."""
    return nodes.select("row").join(found.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("comp", "row").alias("comp"))
