"""Text probability by a subword lattice.

The pieces and first scores come from a public tokenizer's vocabulary. A word's lattice has an edge
for each piece, and for each single byte, that occurs in it; the word's probability is the sum over
all paths, found by a forward recursion in log space over all words of a chunk at once. The
vocabulary stays as it is; the piece probabilities are fitted to the training documents' words, each
as often as it occurs, by expectation-maximisation. The first piece of a word holds the mark of its start, so that a path stops where
the next word starts. A text is drawn piece by piece until the end token, which has a share of the
draws: a text's probability is the product over its words and the end, and all texts' sum to one.

Word counts come from all training documents. A block of documents holds its distinct words once;
only these go through the shuffles, and each document is scored against its block's words.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weeklane.llm.common import cut, text_of
from weeklane.llm.minhash import MIX

TOP = 18  # bits by which the pieces are looked up
CELLS = 400_000  # bytes of the words that are looked at together
BLOCK_WORDS, BLOCK_TOKENS = 300_000, 4_000_000  # a block of documents is closed beyond either


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, with the mark of a word's start as one zero byte, and first log weights."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", "\0").encode().lower()
        if b"\0" not in piece[1:] and piece != b"\0":
            own[piece] = max(own.get(piece, -1e9), model.get_score(i))
    for b in range(256):
        own.setdefault(bytes([b]), min(own.values()) if own else 0.0)
    pieces = sorted(own)
    score = np.array([own[p] for p in pieces])
    if score.min() < -1000:  # scores that are ranks of merges: Zipf's law over the ranks
        score = -np.log(10.0 - score)
    return pieces, score - np.logaddexp.reduce(score)


def prefix_hashes(cells: np.ndarray) -> np.ndarray:
    """Rolling hashes of each row's first k bytes, for k from 0."""
    h = np.zeros((cells.shape[0], cells.shape[1] + 1), np.uint64)
    for k in range(cells.shape[1]):
        h[:, k + 1] = h[:, k] * MIX[0] + (cells[:, k].astype(np.uint64) + np.uint64(1)) * MIX[1]
    return h


def piece_table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the pieces, and their numbers."""
    h = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        h[i] = prefix_hashes(np.frombuffer(p, np.uint8)[None, :])[0, -1]
    order = np.argsort(h)
    return h[order], order


class Lattice:
    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, logp: np.ndarray, longest: int):
        self.longest = longest  # bytes of a piece
        self.hashes, self.numbers, self.logp = hashes, numbers, logp
        top = (hashes >> np.uint64(64 - TOP)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << TOP) + 1))  # where hashes with these top bits start
        self.power = np.array([pow(int(MIX[0]), k, 1 << 64) for k in range(longest + 1)], np.uint64)

    def chunks(self, words: list[bytes]):
        """Words of about the same length as a matrix of bytes: (places in words, lengths, cells)."""
        size = np.array([len(w) for w in words], np.int64) + 1
        order, at = np.argsort(size, kind="stable"), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * size[order[end]] <= CELLS and size[order[end]] <= size[order[at]] + 2:
                end += 1
            of, width = order[at:end], int(size[order[end - 1]])
            flat = b"".join((b"\0" + words[i]).ljust(width, b"\0") for i in of)
            yield of, size[of], np.frombuffer(flat, np.uint8).reshape(len(of), width)
            at = end

    def edges(self, h: np.ndarray, end: int, length: int) -> np.ndarray:
        """The piece that covers the bytes from end - length to end of each word, or -1."""
        key = h[:, end] - h[:, end - length] * self.power[length]
        top = (key >> np.uint64(64 - TOP)).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        rows = np.flatnonzero(at < stop)
        out = np.full(len(key), -1)
        while len(rows):
            same = self.hashes[at[rows]] == key[rows]
            out[rows[same]] = self.numbers[at[rows[same]]]
            rows = rows[~same]
            at[rows] += 1
            rows = rows[at[rows] < stop[rows]]
        return out

    def forward(self, cells: np.ndarray) -> tuple[np.ndarray, list]:
        """Log of the sum over all paths to each place, and the edges (end, length, pieces)."""
        h, all_edges = prefix_hashes(cells), []
        alpha = np.full((cells.shape[0], cells.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, cells.shape[1] + 1):
            for length in range(1, min(end, self.longest) + 1):
                piece = self.edges(h, end, length)
                has = np.flatnonzero(piece >= 0)
                if len(has):
                    alpha[has, end] = np.logaddexp(alpha[has, end], alpha[has, end - length] + self.logp[piece[has]])
                    all_edges.append((end, length, has, piece[has]))
        return alpha, all_edges

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability over all paths."""
        out = np.zeros(len(words))
        for of, size, cells in self.chunks(words):
            alpha, _ = self.forward(cells)
            out[of] = alpha[np.arange(len(of)), size]
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all paths of all words, each so many times."""
        out = np.zeros(len(self.logp))
        for of, size, cells in self.chunks(words):
            alpha, edges = self.forward(cells)
            beta = np.full(alpha.shape, -np.inf)
            beta[np.arange(len(size)), size] = 0
            total = alpha[np.arange(len(size)), size]
            for end, length, has, piece in reversed(edges):
                on = self.logp[piece] + beta[has, end]
                use = times[of[has]] * np.exp(alpha[has, end - length] + on - total[has])
                out += np.bincount(piece, use, len(out))
                beta[has, end - length] = np.logaddexp(beta[has, end - length], on)
        return out


def coded(docs: DataFrame) -> DataFrame:
    """Documents as numbers of their block's words, and one row per block with its words and their
    counts in the block's training documents. docs: doc, held, text."""

    def run(batches):
        import uuid

        def close():
            n = len(rows)
            block = [name] * (n + 1)
            cols = [
                pa.array(block), pa.array([r[0] for r in rows] + [None], kind), pa.array([r[1] for r in rows] + [None], pa.bool_()),
                pa.array([zlib.compress(r[2].tobytes(), 1) for r in rows] + [None], pa.binary()), pa.array([None] * n + [list(known)], pa.list_(pa.binary())), pa.array([None] * n + [count[: len(known)]], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(cols, ["block", "doc", "held", "tokens", "words", "counts"])

        name, rows, known, count, tokens = uuid.uuid4().hex, [], {}, np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            kind = batch.column("doc").type
            for doc, held, text in zip(batch.column("doc").to_pylist(), batch.column("held").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                at = np.array([known.setdefault(w, len(known)) for w in text.lower().split()], np.int32)
                while len(known) > len(count):
                    count = np.r_[count, np.zeros(len(count), np.int64)]
                if not held:
                    own, times = np.unique(at, return_counts=True)
                    count[own] += times
                rows.append((doc, held, at))
                tokens += len(at)
                if len(known) >= BLOCK_WORDS or tokens >= BLOCK_TOKENS:
                    yield close()
                    name, rows, known, count, tokens = uuid.uuid4().hex, [], {}, np.zeros(1 << 16, np.int64), 0
        if rows:
            yield close()

    kind = dict(docs.dtypes)["doc"]
    return docs.mapInArrow(run, f"block string, doc {kind}, held boolean, tokens binary, words array<binary>, counts array<long>")


def fitted_pieces(vocab: DataFrame, path: str, rounds: int, prior: float, ends: int):
    """(piece table, log weights, longest piece, log weight of the end) after so many rounds over the training documents' words."""
    pieces, logp = read_pieces(path)
    hashes, numbers = piece_table(pieces)
    longest = max(map(len, pieces))
    first = np.exp(logp)
    uses = prior * first
    for _ in range(rounds):
        shared = vocab.sparkSession.sparkContext.broadcast((hashes, numbers, logp, longest))

        def run(batches, shared=shared):
            lattice = Lattice(*shared.value)
            total = np.zeros(len(lattice.logp))
            for batch in batches:
                total += lattice.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "uses"])

        got = vocab.where("c > 0").select("word", "c").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # at most one row per piece
        uses = prior * first
        for r in got:
            uses[r["piece"]] += r["uses"]
        logp = np.log(uses / uses.sum())
    whole = uses.sum() + max(ends, 1)
    return hashes, numbers, np.log(uses / whole), longest, float(np.log(max(ends, 1) / whole))


def lattice_scores(docs: DataFrame, held, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, prior: float = 1000.0) -> DataFrame:
    """Per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held: condition over the id column; null counts as false. path: a sentencepiece model's file,
    read by the driver. Words are runs without the six ASCII blanks, A-Z lower-cased. A null text
    is empty and has its end token only. Repeated rows are documents of their own. Without training
    documents base_score is 0 for each token, and pieces keep their first weights.
    """
    own = docs.select(F.col(id_col).alias("doc"), F.coalesce(held, F.lit(False)).alias("held"), text_of(text_col).alias("text"))
    blocks = cut(coded(own), "blocks")
    words = blocks.where("words is not null").select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("block", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    vocab = cut(words.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    ends = blocks.where("words is null and not held").count()
    sums = vocab.where("c > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    *model, end_p = fitted_pieces(vocab, path, rounds, prior, ends)
    parts = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def score(batches):
        lattice = Lattice(*parts.value)
        for batch in batches:
            p = lattice.scores(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(p / np.log(10))], ["word", "c", "p"])

    scored = vocab.mapInArrow(score, "word binary, c long, p double")
    in_blocks = words.select("block", "at", "word").join(scored, "word").select(F.col("block").alias("in_block"), "at", "c", "p")
    end_p /= float(np.log(10))
    end_base = float(np.log10((ends + 1) / (n + v + 1)))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        size = (pc.max(right["at"]).as_py() + 1) if right.num_rows else 1
        c, p = np.zeros(size, np.int64), np.zeros(size)
        at = right["at"].to_numpy()
        c[at], p[at] = right["c"].to_numpy(), right["p"].to_numpy()
        base = np.log10((c + 1) / (n + v + 1))
        tokens = [np.frombuffer(zlib.decompress(t), np.int32) for t in left["tokens"].to_pylist()]
        flat, ends_at = np.concatenate(tokens), np.r_[0, np.cumsum([len(t) for t in tokens])]

        count = np.diff(ends_at)
        return pa.table({
            "doc": left["doc"], "held": left["held"], "n_tokens": count + 1, "n_known": each_sum(c > 0, flat, ends_at).astype(np.int64) + int(ends > 0),
            "base": each_sum(base, flat, ends_at) + end_base, "p": each_sum(p, flat, ends_at) + end_p,
        })

    left = blocks.where("words is null").select("block", "doc", "held", "tokens")
    kind = dict(own.dtypes)["doc"]
    out = left.groupBy("block").cogroup(in_blocks.groupBy("in_block")).applyInArrow(place, f"doc {kind}, held boolean, n_tokens long, n_known long, base double, p double")
    return out.select(F.col("doc").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("p").alias("score"))


def each_sum(x: np.ndarray, flat: np.ndarray, ends_at: np.ndarray) -> np.ndarray:
    """Sums of x over each document's tokens."""
    out = np.zeros(len(ends_at) - 1)
    some = np.flatnonzero(np.diff(ends_at))
    if len(some):
        out[some] = np.add.reduceat(x[flat], ends_at[:-1][some])
    return out
