"""Nearest neighbours by inner product over an NN-descent graph.

Equal vectors are one node. Each vector gets one more component, so that all have the length of
the longest: then the largest inner products of a query are its nearest points, and the graph is
built for that distance. The component is kept as what it lacks to that length, so that it is small
for short vectors and distances between them don't drown beside a long one. The graph starts from random-projection leaves of bounded size and is refined by
rounds of joins: the neighbours and some reverse neighbours of a node meet and are compared with
one another. The search walks both, as short lists alone lead away from the long vectors. A query starts at its own node and the longest vectors and greedily opens the best nodes
of its beam, in rounds over all queries, until the best ``beam`` nodes are all opened. Graph and
search compare in double precision.

In a round a drawn part of each neighbourhood meets, and pairs that a list holds already are left out.
After ROUNDS rounds of joins the queries are searched, and a sample of bounded size is held against a
scan of all nodes. If the sample's recall is not the one asked for, the beam doubles a few times, then rounds
go on, with such a search after twice as many each time, until few list entries change; then the beam doubles
further. If no beam within bounds does, the graph is built with
twice the lists and trees, a few times; after that the search ends with an error that names the recall.

The joins and the search's lists carry vectors as 16-bit whole numbers of each vector's own scale; what
the beams hold at the end is scored on the original vectors.

The index holds every row.
"""

import itertools
import logging
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weeklane.llm.common import cut, shared_dir

log = logging.getLogger(__name__)
SALTS = 16
SAMPLE = 200  # queries that are held against a scan of all nodes
MIDDLE = SHORT = np.int16  # components that the joins of the graph, and the search, carry; 8 bits don't tell near copies apart
BLOCK = 4096  # nodes whose lists lie together
ASKED = 512  # queries whose beams lie together
KNOWN = 512  # bits of a list's bitmap
GROWN = 3  # times that the graph's lists and trees are doubled
ROUNDS = 2  # joins before the first search
SOONER = 4  # times the first beam that is tried before the lists are settled: a sample's search costs less than a round
FEW = 4000  # queries that are searched at once, without the sample's first


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int, salt: str) -> DataFrame:
    """The first n rows of each group; large groups are cut down in parts first."""
    part = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    part = part.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("_k") <= n)
    return part.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k", "_salt")


def groups(batches, key: str, rows: int = 50_000):
    """Tables of whole groups from batches that are sorted by the key."""
    held: list = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table[key].to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if end:
                yield table.slice(0, end)
            held, count = table.slice(end).to_batches(), table.num_rows - end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def points(column, dim: int) -> np.ndarray:
    """Binary single-precision vectors as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)


def coded(x: np.ndarray, kind) -> pa.Array:
    """Each row as whole numbers of its own scale: four bytes of scale, then the components."""
    top = np.iinfo(kind).max
    scale = np.maximum(np.abs(x).max(1), np.finfo(np.float32).tiny) / top
    whole = np.clip(np.rint(x / scale[:, None]), -top, top).astype(kind)
    return pa.array([s.tobytes() + w.tobytes() for s, w in zip(scale.astype(np.float32), whole, strict=True)], pa.binary())


def decoded(column, dim: int, kind) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 4 + dim * np.dtype(kind).itemsize)
    scale = raw[:, :4].copy().view(np.float32).astype(np.float64)
    return raw[:, 4:].copy().view(kind) * scale


def nearness(x: np.ndarray) -> np.ndarray:
    """Minus the squared distances of the rows to one another; a row has none to itself."""
    norm = (x * x).sum(1)
    sim = 2 * (x @ x.T)
    sim -= norm[:, None]
    sim -= norm
    np.fill_diagonal(sim, -np.inf)
    return sim


def lifted(x: np.ndarray, longest: float, scale: float) -> np.ndarray:
    """The rows over the scale, with what their added component lacks to the longest's length."""
    x, top = x / scale, longest / scale
    norm = (x * x).sum(1)
    lack = norm / (top + np.sqrt(np.maximum(0, top * top - norm)))
    return np.concatenate([x, lack[:, None]], 1).astype(np.float32)


def best_lists(node: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int):
    """(node, others, similarities) of each node's k best, from pairs with repeats."""
    order = np.lexsort((other, node))
    node, other, sim = node[order], other[order], sim[order]
    new = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])] if len(node) else np.zeros(0, bool)
    node, other, sim = node[new], other[new], sim[new]
    order = np.lexsort((other, -sim, node))
    node, other, sim = node[order], other[order], sim[order]
    rank = np.arange(len(node)) - np.searchsorted(node, node)
    node, other, sim = node[rank < k], other[rank < k], sim[rank < k]
    names, start = np.unique(node, return_index=True)
    offsets = pa.array(np.r_[start, len(node)].astype(np.int32))
    return pa.array(names), pa.ListArray.from_arrays(offsets, pa.array(other)), pa.ListArray.from_arrays(offsets, pa.array(sim.astype(np.float64)))


LISTS = "node long, nbrs array<long>, sims array<double>"


def merged(lists: DataFrame, k: int) -> DataFrame:
    """Each node's k best of all its lists."""

    def run(batches):
        for t in groups(batches, "node"):
            size = t["nbrs"].combine_chunks()
            node = np.repeat(t["node"].to_numpy(), pa.compute.list_value_length(size).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(list(best_lists(node, size.flatten().to_numpy(), t["sims"].combine_chunks().flatten().to_numpy(), k)), ["node", "nbrs", "sims"])

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, LISTS)


def forest(nodes: DataFrame, dim: int, trees: int, leaf: int, k: int, seed: int) -> DataFrame:
    """Lists from leaves of random projections: nodes in the order of their sign bits, leaf by leaf."""
    count = nodes.count()
    bits = min(60, max(1, math.ceil(math.log2(max(count / leaf, 1))) + 2))

    def project(batches):
        rng = np.random.default_rng(seed)
        planes = rng.standard_normal((trees, dim, bits))
        planes[:, -1] = 0  # the added component has no middle at 0
        for batch in batches:
            x = points(batch.column("point"), dim)
            for t in range(trees):
                p = x @ planes[t]
                key = (p > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(key), pa.array(p[:, 0].astype(np.float64)), batch.column("node"), batch.column("point")], ["tree", "key", "along", "node", "point"])

    def compare(batches):
        for table in leaves(batches):
            x, node = points(table["point"], dim), table["node"].to_numpy()
            sim = nearness(x)
            m = min(k, len(node) - 1)
            if m < 1:
                continue
            best = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            offsets = pa.array(np.arange(0, len(node) * m + 1, m, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(offsets, pa.array(node[best].ravel())), pa.ListArray.from_arrays(offsets, pa.array(np.take_along_axis(sim, best, 1).ravel()))], ["node", "nbrs", "sims"])

    def leaves(batches):
        for table in groups(batches, "tree", 4 * leaf):
            trees_of = table["tree"].to_numpy()
            for t in np.unique(trees_of):
                own = table.slice(int(np.searchsorted(trees_of, t)), int((trees_of == t).sum()))
                parts = max(1, round(own.num_rows / leaf))
                edge = np.linspace(0, own.num_rows, parts + 1).astype(int)
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    yield own.slice(a, b - a)

    placed = nodes.select("node", "point").mapInArrow(project, "tree int, key long, along double, node long, point binary")
    sorted_ = placed.repartitionByRange("tree", "key", "along").sortWithinPartitions("tree", "key", "along", "node")
    return merged(sorted_.mapInArrow(compare, LISTS), k)


def both_ways(graph: DataFrame, reverse: int, seed: int) -> DataFrame:
    """(node, nbr): each node's list, and some of the nodes whose lists hold it."""
    edges = graph.select("node", F.explode("nbrs").alias("nbr"))
    back = first_rows(edges, ["nbr"], [F.xxhash64("node", F.lit(seed)), F.col("node")], reverse, "node")
    return edges.union(back.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()


def bit(ids: np.ndarray, seed: int) -> np.ndarray:
    """Each id's place in a bitmap of KNOWN bits."""
    with np.errstate(over="ignore"):
        return ((ids.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(KNOWN)


def refined(graph: DataFrame, nodes: DataFrame, dim: int, k: int, reverse: int, each: int, share: float, seed: int) -> DataFrame:
    """One round: whoever share a neighbour are compared; each node keeps its k best.

    Of each neighbourhood a share meets, drawn anew each round. A node carries a bitmap of its list, so
    that what it holds is not found again; where a bit hides another node, the next round's bitmap doesn't.
    """
    drawn = F.pmod(F.xxhash64("node", "nbr", F.lit(seed)), F.lit(1000)) < int(1000 * share)
    meet = both_ways(graph, reverse, seed).where(drawn).select(F.col("node").alias("at"), F.col("nbr").alias("node"))

    def carried(batches):
        for batch in batches:
            size = pa.compute.list_value_length(batch.column("nbrs")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            held = np.zeros((batch.num_rows, KNOWN), bool)
            held[row, bit(batch.column("nbrs").flatten().to_numpy(), seed)] = True
            worst = np.full(batch.num_rows, np.inf)
            np.minimum.at(worst, row, batch.column("sims").flatten().to_numpy())
            worst[size < k] = -np.inf
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(worst), pa.array([r.tobytes() for r in np.packbits(held, axis=1)], pa.binary())], ["node", "worst", "known"])

    lists = graph.mapInArrow(carried, "node long, worst double, known binary")
    seen = meet.join(nodes.select("node", "code").join(lists, "node", "left"), "node")

    def run(batches):
        for t in groups(batches, "at", 20_000):
            at, node = t["at"].to_numpy(), t["node"].to_numpy()
            worst = t["worst"].fill_null(float("-inf")).to_numpy()
            x, place = decoded(t["code"], dim, MIDDLE), bit(node, seed)
            held = np.frombuffer(b"".join(b or bytes(KNOWN // 8) for b in t["known"].to_pylist()), np.uint8).reshape(-1, KNOWN // 8)
            start = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
            us, ws, ss = [], [], []
            for a, b in zip(start[:-1], start[1:], strict=True):
                m = min(each, b - a - 1)
                if m < 1:
                    continue
                sim = nearness(x[a:b])
                sim[np.unpackbits(held[a:b], axis=1)[:, place[a:b]] > 0] = -np.inf
                best = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                sim = np.take_along_axis(sim, best, 1)
                row, col = np.nonzero(sim > worst[a:b, None])
                us.append(node[a + row])
                ws.append(node[a + best[row, col]])
                ss.append(sim[row, col])
            if us:
                yield pa.RecordBatch.from_arrays(list(best_lists(np.concatenate(us), np.concatenate(ws), np.concatenate(ss), k)), ["node", "nbrs", "sims"])

    found = seen.select("at", "node", "code", "worst", "known").repartition("at").sortWithinPartitions("at").mapInArrow(run, LISTS)
    return merged(graph.union(found), k)


ENTRIES = 32  # longest vectors, from which each query starts too
BEAMS = "part int, size int, open_ int, qs binary, points binary, nodes binary, sims binary, open binary"
ASKS = "block int, part int, at binary, points binary, low binary, node binary"
FOUND = "part int, at binary, nodes binary, sims binary"


def place(ids, n: int):
    """Which of n blocks an id lies in; ids are a column or an array."""
    if isinstance(ids, Column):
        return F.pmod(ids.bitwiseXOR(F.shiftright(ids, 5)).bitwiseXOR(F.shiftright(ids, 33)), F.lit(n)).cast("int")
    return ((ids ^ (ids >> 5) ^ (ids >> 33)) % n).astype(np.int32)


def blocks_of(nodes: DataFrame, count: int) -> int:
    """Blocks of nodes, no fewer than Spark's partitions, so that a bucket each is never dealt anew."""
    return max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / BLOCK))


def raw(column) -> np.ndarray:
    """The bytes of a binary column, one value after the other."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([np.zeros(0, np.uint8), *map(raw, column.chunks)])
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) and ends[-1] > ends[0] else np.zeros(0, np.uint8)


def sliced(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in an array, from each of the ends to the next."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def adjacency(graph: DataFrame, nodes: DataFrame, dim: int, reverse: int, blocks: int, seed: int) -> str:
    """Name of a table (block, node, nbrs, codes) in buckets by block: whom a node's list holds, some whose lists hold it, and their vectors."""
    flat = both_ways(graph, reverse, seed).join(nodes.select(F.col("node").alias("nbr"), "code"), "nbr")
    width = 4 + dim * np.dtype(SHORT).itemsize

    def pack(batches):
        for t in groups(batches, "node", 20_000):
            node = t["node"].to_numpy()
            names, start = np.unique(node, return_index=True)
            ends = np.r_[start, len(node)]
            yield pa.RecordBatch.from_arrays([pa.array(place(names, blocks)), pa.array(names), sliced(t["nbr"].to_numpy(), ends), sliced(raw(t["code"]), ends * width)], ["block", "node", "nbrs", "codes"])

    packed = flat.withColumn("block", place(F.col("node"), blocks)).repartition(blocks, "block").sortWithinPartitions("node").mapInArrow(pack, "block int, node long, nbrs binary, codes binary")
    name = f"adjacency_{uuid.uuid4().hex}"
    packed.write.bucketBy(blocks, "block").option("path", f"{shared_dir(nodes.sparkSession).rstrip('/')}/{name}").saveAsTable(name)
    return name


def searched(lists: DataFrame, nodes: DataFrame, queries: DataFrame, dim: int, beam: int, opened: int, blocks: int, longest: float, top: int) -> DataFrame:
    """(q, node): each query node's beam as far as rounding lets it hold one of the top, and itself. lists: adjacency(); queries: q, point.

    A round sends each query to the best unopened nodes of its beam, where their neighbours are
    compared with it, and merges what is better than the beam's last back into the beam. Queries
    and nodes travel and are compared by blocks; the lists, in buckets, stay where they are.
    """
    parts = max(1, math.ceil(queries.count() / ASKED))

    def best(q, ids, sims, is_open, n):
        """n beams as matrices: each node once (opened if any says so), nearest first."""
        order = np.lexsort((is_open, ids, q))
        q, ids, sims, is_open = q[order], ids[order], sims[order], is_open[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]
        q, ids, sims, is_open = q[new], ids[new], sims[new], is_open[new]
        order = np.lexsort((-sims, q))  # of equal ones, the smaller id stays first
        q, ids, sims, is_open = q[order], ids[order], sims[order], is_open[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < beam
        at = (q[keep], rank[keep])
        out = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf), np.zeros((n, beam), bool)
        for x, y in zip(out, (ids, sims, is_open), strict=True):
            x[at] = y[keep]
        return out

    def row(part, qs, points, ids, sims, is_open):
        return pa.Table.from_pydict({"part": pa.array([part], pa.int32()), "size": pa.array([len(qs)], pa.int32()), "open_": pa.array([int(is_open.sum())], pa.int32())} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in (("qs", qs), ("points", points), ("nodes", ids), ("sims", sims), ("open", is_open))})

    def matrices(t, i):
        n = t["size"][i].as_py()
        read = lambda c, kind: np.frombuffer(t[c][i].as_buffer(), kind)
        return read("qs", np.int64), read("points", np.float32).reshape(n, dim), read("nodes", np.int64).reshape(n, beam), read("sims", np.float64).reshape(n, beam), read("open", bool).reshape(n, beam)

    def chosen(is_open):
        """The best unopened entries of each beam."""
        return is_open & (np.cumsum(is_open, 1) <= opened)

    def pick(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, points, ids, sims, is_open = matrices(batch, i)
                q, col = np.nonzero(chosen(is_open))
                node = ids[q, col]
                block = place(node, blocks)
                order = np.argsort(block, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else ():
                    at, of = np.unique(q[own], return_inverse=True)
                    columns = at.astype(np.int32), points[at], sims[at, -1], np.stack([of, node[own]])
                    yield pa.RecordBatch.from_arrays([pa.array([block[own[0]]], pa.int32()), batch["part"][i : i + 1], *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["block", "part", "at", "points", "low", "node"])

    def named(batches):
        for batch in batches:
            for node in batch["node"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(node.as_buffer(), np.int64).reshape(2, -1)[1])], ["node"])

    def score(near, asks):
        if not near.num_rows or not asks.num_rows:
            return pa.Table.from_pylist([], pa.schema([("part", pa.int32()), ("at", pa.binary()), ("nodes", pa.binary()), ("sims", pa.binary())]))
        order = np.argsort(near["node"].to_numpy())
        near = near.take(pa.array(order)) if (order[1:] < order[:-1]).any() else near
        names, sizes = near["node"].to_numpy(), pa.compute.binary_length(near["nbrs"]).to_numpy() // 8
        start = np.r_[0, np.cumsum(sizes)]
        nbrs, codes = raw(near["nbrs"]).view(np.int64), raw(near["codes"]).reshape(-1, 4 + dim * np.dtype(SHORT).itemsize)
        scale, whole = codes[:, :4].copy().view(np.float32)[:, 0], codes[:, 4:].copy().view(SHORT)
        points, low = raw(asks["points"]).view(np.float32).reshape(-1, dim), raw(asks["low"]).view(np.float64)
        first = np.r_[0, np.cumsum(pa.compute.binary_length(asks["low"]).to_numpy() // 8)]
        pairs = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) + [[a], [0]] for x, a in zip(asks["node"], first[:-1].tolist(), strict=True)]
        of, node = np.concatenate(pairs, 1)
        at = np.searchsorted(names, node)
        known = np.flatnonzero((at < len(names)) & (names[np.minimum(at, len(names) - 1)] == node))  # the others are in no list
        known = known[np.argsort(at[known], kind="stable")]
        at, of = at[known], of[known]
        edge = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)] if len(at) else np.zeros(1, int)
        who, other, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in itertools.pairwise(edge.tolist()):
            own, (s, e) = of[a:b], start[at[a] : at[a] + 2]
            sim = (whole[s:e].astype(np.float32) @ points[own].T) * scale[s:e, None]
            r, c = np.nonzero(sim > low[own])
            who.append(own[c])
            other.append(nbrs[s + r])
            sims.append(sim[r, c].astype(np.float64))
        who, other, sims = map(np.concatenate, (who, other, sims))
        order = np.lexsort((other, who))
        order = order[np.r_[True, (who[order][1:] != who[order][:-1]) | (other[order][1:] != other[order][:-1])]] if len(order) else order
        who, other, sims = who[order], other[order], sims[order]
        ends = np.searchsorted(who, first)
        where = raw(asks["at"]).view(np.int32)[who]
        return pa.Table.from_arrays([asks["part"].combine_chunks(), sliced(where, ends), sliced(other, ends), sliced(sims, ends)], ["part", "at", "nodes", "sims"])

    def merge(beams, found):
        qs, points, ids, sims, is_open = matrices(beams, 0)
        q, col = np.nonzero(ids >= 0)
        left = is_open & ~chosen(is_open)
        new = raw(found["at"]).view(np.int32), raw(found["nodes"]).view(np.int64), raw(found["sims"]).view(np.float64)
        whole = best(np.r_[q, new[0]], np.r_[ids[q, col], new[1]], np.r_[sims[q, col], new[2]], np.r_[left[q, col], np.ones(len(new[0]), bool)], len(qs))
        return row(beams["part"][0].as_py(), qs, points, *whole)

    long = nodes.orderBy(F.desc("norm"), "node").limit(ENTRIES).select("node", "point").toArrow()
    entries = (long["node"].to_numpy(), points(long["point"], dim))

    def begin(batches):
        for t in groups(batches, "part", 4 * ASKED):
            part = t["part"].to_numpy()
            for own in np.unique(part):
                some = t.filter(pa.array(part == own))
                qs, x = some["q"].to_numpy(), points(some["point"], dim)
                n = len(qs)
                sims, other = x @ entries[1].T, entries[0] != qs[:, None]
                q, e = np.nonzero(other)
                whole = best(np.r_[np.arange(n), q], np.r_[qs, entries[0][e]], np.r_[np.full(n, np.inf), sims[q, e]], np.ones(n + len(q), bool), n)
                yield from row(own, qs, x.astype(np.float32), *whole).to_batches()

    spread = queries.select("q", "point", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part")).repartition("part").sortWithinPartitions("part")
    beams = cut(spread.mapInArrow(begin, BEAMS), "beam")
    while True:
        count = beams.agg(F.sum(F.least(F.col("open_"), F.col("size") * opened))).first()[0]
        if not count:
            break
        asks, near = beams.mapInArrow(pick, ASKS), lists
        if count <= 50_000:  # then few of the lists are asked for
            asks = cut(asks, "opened")
            near = lists.join(F.broadcast(asks.mapInArrow(named, "node long").distinct()), "node", "left_semi").select("block", "node", "nbrs", "codes")
        found = near.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(score, FOUND)
        beams = cut(beams.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(merge, BEAMS), "beam")

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qs, points, ids, sims, _ = matrices(batch, i)
                # what the codes and single precision may be off, twice, by the longest vector's length
                off = 2 * (math.sqrt(dim) / 2 / np.iinfo(SHORT).max + (dim + 8) * 2.0**-23) * longest * np.linalg.norm(points, axis=1)
                q, col = np.nonzero((ids >= 0) & (sims >= (sims[:, min(top + 1, beam - 1)] - off)[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(qs[q]), pa.array(ids[q, col])], ["q", "node"])

    return beams.mapInArrow(unpack, "q long, node long")


def scanned(nodes: DataFrame, sample: DataFrame, dim: int, keep: int) -> DataFrame:
    """(q, node, sim): each sampled query's keep best other nodes, and itself at infinity, by a scan of all nodes."""
    own = sample.select("q", "point").toArrow()  # SAMPLE rows at most
    ids, of = own["q"].to_numpy(), points(own["point"], dim) if own.num_rows else np.zeros((0, dim))

    def scan(batches):
        node, sim = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for part in (b.slice(at, 2_000) for b in batches for at in range(0, b.num_rows, 2_000)):
            other = part.column("node").to_numpy()
            near = of @ points(part.column("point"), dim).T
            near[ids[:, None] == other] = np.inf
            node, sim = np.concatenate([node, np.broadcast_to(other, near.shape)], 1), np.concatenate([sim, near], 1)
            if sim.shape[1] > keep + 1:
                best = np.argpartition(-sim, keep, axis=1)[:, : keep + 1]
                node, sim = np.take_along_axis(node, best, 1), np.take_along_axis(sim, best, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, node.shape[1])), pa.array(node.ravel()), pa.array(sim.ravel())], ["q", "node", "sim"])

    return first_rows(nodes.select("node", "point").mapInArrow(scan, "q long, node long, sim double"), ["q"], [F.desc("sim"), F.col("node")], keep + 1, "node")


def share_found(found: DataFrame, nodes: DataFrame, sample: DataFrame, best: DataFrame, dim: int, top: int) -> float:
    """Share of the sampled queries' best nodes that found holds, by their products without codes; nodes that tie with the last count alike."""

    def product(batches):
        for batch in batches:
            sim = np.einsum("ij,ij->i", points(batch.column("own"), dim), points(batch.column("point"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(sim)], ["q", "node", "sim"])

    own = F.broadcast(sample.select("q", F.col("point").alias("own")))  # SAMPLE rows at most
    pairs = found.where("q <> node").select("q", "node").join(nodes.select("node", "point"), "node").join(own, "q")
    exact = pairs.select("q", "node", "own", "point").mapInArrow(product, "q long, node long, sim double")
    least = best.where("q <> node").groupBy("q").agg(F.min("sim").alias("least"), F.max(F.abs("sim")).alias("most"), F.count("*").alias("n"))
    near = exact.join(least, "q").where(F.col("sim") >= F.col("least") - 1e-9 * F.col("most"))
    got = near.groupBy("q").agg(F.least(F.count("*"), F.lit(top)).alias("got"))
    return least.join(got, "q", "left").agg((F.sum(F.coalesce("got", F.lit(0))) / F.sum("n")).alias("share")).first()["share"] or 0.0


def followed(lists: DataFrame, nodes: DataFrame, queries: DataFrame, sample: DataFrame, best: DataFrame, dim: int, beam: int, opened: int, top: int, recall: float, most: int, blocks: int, longest: float) -> tuple[DataFrame | None, float]:
    """((q, node) of all queries, recall) with the first beam, of doubled ones, whose recall on the sample is as asked for; None if none of up to ``most`` has it.

    The first beam is tried on all queries where they are few, as it mostly does; else, and for others, on the sample first.
    """
    share, mine, whole = 0.0, F.broadcast(sample.select("q")), queries.count() <= FEW  # SAMPLE rows at most
    while beam <= most:
        found = searched(lists, nodes, queries if whole else sample, dim, beam, opened, blocks, longest, top)
        share = share_found(found.join(mine, "q", "left_semi"), nodes, sample, best, dim, top)
        log.info("beam %d: recall %.4f on a sample", beam, share)
        if share >= recall:
            return found if whole else searched(lists, nodes, queries, dim, beam, opened, blocks, longest, top), share
        beam, opened, whole = 2 * beam, 2 * opened, False
    return None, share


def graphs(nodes: DataFrame, dim: int, trees: int, leaf: int, k: int, reverse: int, each: int, share: float, settled: float, seed: int) -> Iterator[tuple[DataFrame, bool]]:
    """Lists of k neighbours after ROUNDS rounds, after twice as many each time, and once they are settled, and whether they are."""
    graph = cut(forest(nodes, dim, trees, leaf, k, seed), "graph")
    for turn in itertools.count():
        before, graph = graph, cut(refined(graph, nodes, dim, k, reverse, each, share, seed + turn), "graph")
        old = before.select("node", F.col("nbrs").alias("old"))
        new = F.when(F.col("old").isNull(), F.size("nbrs")).otherwise(F.size(F.array_except("nbrs", "old")))
        changed = graph.join(old, "node", "left").agg((F.sum(new) / F.sum(F.size("nbrs"))).alias("share")).first()["share"] or 0.0
        log.info("round %d: %.4f of the list entries changed", turn, changed)
        if changed <= settled or turn + 1 in (ROUNDS << i for i in range(turn + 1)):
            yield graph, changed <= settled
        if changed <= settled:
            return


def nearest(vectors: DataFrame, queries: Column, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 32, trees: int = 8, leaf: int = 2048, settled: float = 0.01, drawn: float = 0.6, reverse: int = 24, each: int = 6, beam: int = 260, opened: int = 90, recall: float = 0.96, most: int = 4160, seed: int = 7) -> DataFrame:
    """(query_id, rank, id, score): each query row's nearest other rows, largest inner product first,
    ties to the smaller id.

    queries: condition over the id column. Rows with a null id, a null or zero vector, a null or
    non-finite component, or another length than most vectors (ties: the longer) take no part.
    Repeated rows are rows of their own; a row is never its own neighbour.

    settled: share of list entries below which a round's changes end the joins; drawn: share of a
    neighbourhood that meets in a round. recall: the least on
    the sample; beam: the first one; most: the largest one before the graph's lists are doubled.
    """
    v = F.col("v")
    fine = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v")).where(fine)
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "asks", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("norm"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(seed), v).alias("h2")), "vectors")
    common = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    dim, longest = common["dim"] + 1, math.sqrt(common["norm"]) or 1.0
    rows = rows.where(F.col("dim") == dim - 1)
    names = rows.groupBy("h1", "h2").agg(F.min("row").alias("node"))
    named = cut(rows.select("row", "id", "asks", "h1", "h2").join(names, ["h1", "h2"]).select("row", "id", "asks", "node"), "rows")

    scale = 2.0 ** math.ceil(math.log2(longest))  # a power of two: single-precision vectors stay as they are

    def lift(batches):
        for batch in batches:
            full = lifted(np.array(batch.column("v").flatten(), np.float64).reshape(-1, dim - 1), longest, scale)
            plain = full.copy()
            plain[:, -1] = 0
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("v"), batch.column("norm"), pa.array([r.tobytes() for r in full], pa.binary()), pa.array([r.tobytes() for r in plain], pa.binary()), coded(full, MIDDLE)], ["node", "v", "norm", "point", "query", "code"])

    first = rows.join(names.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = cut(first.select("row", "v", "norm").mapInArrow(lift, "node long, v array<double>, norm double, point binary, query binary, code binary"), "nodes")
    asking = named.where("asks").select(F.col("node").alias("q")).distinct()
    asked = cut(asking.join(nodes.select(F.col("node").alias("q"), F.col("query").alias("point")), "q"), "queries")
    sample = cut(asked.orderBy(F.xxhash64("q"), "q").limit(SAMPLE), "sample")
    best = cut(scanned(nodes, sample, dim, top), "best")
    found, share, blocks = best, 1.0, blocks_of(nodes, nodes.count())  # right if no query has another node
    for grown in range(GROWN + 1) if not best.where("q <> node").isEmpty() else ():
        k_, reverse_, trees_ = (x << grown for x in (k, reverse, trees))
        for graph, end in graphs(nodes, dim, trees_, leaf, k_, reverse_, each, drawn, settled, seed):
            name = adjacency(graph, nodes, dim, reverse_, blocks, seed)
            found, share = followed(vectors.sparkSession.table(name), nodes, asked, sample, best, dim, beam, opened, top, recall, most if end else min(most, SOONER * beam), blocks, longest / scale)
            vectors.sparkSession.sql(f"DROP TABLE {name}")  # its files stay, like those of the other tables
            if found is not None:
                break
        if found is not None:
            break
        log.warning("lists of %d and beams of up to %d have recall %.3f on a sample", k_, most, share)
    if found is None:
        raise RuntimeError(f"recall is {share:.3f} on a sample of {SAMPLE} queries, {recall} was asked for: give more trees, longer lists or a larger beam")
    found = found.select("q", "node")

    pairs = found.join(nodes.select(F.col("node").alias("q"), F.col("v").alias("x")), "q").join(nodes.select("node", "v"), "node")
    score = F.aggregate(F.zip_with("x", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = cut(first_rows(pairs.select("q", "node", score.alias("score")), ["q"], [F.desc("score"), F.col("node")], max(beam, top + 1), "node"), "scores")
    held = cut(first_rows(named.select("node", "id", "row"), ["node"], [F.col("id"), F.col("row")], top + 1, "row"), "held")  # more copies can't be among the nearest
    # a query node's best rows, one more than asked for as one of them may be the query itself
    ordered = [F.desc("score"), F.col("id"), F.col("row")]
    some = first_rows(scored.join(held, "node").select("q", "score", "id", "row"), ["q"], ordered, top + 1, "row")
    answers = named.where("asks").select(F.col("id").alias("query_id"), F.col("row").alias("asker"), F.col("node").alias("q")).join(some, "q").where("row <> asker")
    out = answers.withColumn("rank", F.row_number().over(Window.partitionBy("asker").orderBy(*ordered))).where(F.col("rank") <= top)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
