"""Token counts by byte-pair merging with a heap and a linked list.

The merges' ranks come from a public tokenizer's file (its path is a parameter) and are sent to
the executors once; their size is that of the file. A text is cut into its added tokens and into
pieces as the tokenizer cuts it; a piece's count is its symbols minus the merges that happen. No
token ids are made. Pieces' counts are kept in a table of bounded size per task.
"""

import heapq
import json

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weeklane.llm.common import text_of

# Fixed value: the pieces of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 200_000  # pieces whose counts a task remembers


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def read_tokenizer(content: str) -> dict:
    """ranks: {(left, right): (rank, merged)} over symbol numbers; added: special strings."""
    data = json.loads(content)
    model, pre = data["model"], data["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or data["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"] or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("a byte-level BPE tokenizer without a normalizer is needed")
    vocab, ranks = model["vocab"], {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        ranks[vocab[left], vocab[right]] = rank, vocab[left + right]
    added = data["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take blanks or whole words only aren't known here")
    return {"ranks": ranks, "bytes": [vocab[c] for c in byte_symbols()], "added": sorted((t["content"] for t in added), key=len, reverse=True)}


def merged_count(symbols: list[int], ranks: dict) -> int:
    """Symbols that are left when the lowest-ranked adjacent pair is merged again and again."""
    n = len(symbols)
    if n < 2:
        return n
    after, before, count = list(range(1, n + 1)), list(range(-1, n - 1)), n
    heap = [(*r, at, symbols[at], symbols[at + 1]) for at in range(n - 1) if (r := ranks.get((symbols[at], symbols[at + 1])))]
    heapq.heapify(heap)  # by rank, then the leftmost, as merged depends on rank
    while heap:
        _, new, at, left, right = heapq.heappop(heap)
        end = after[at]
        if symbols[at] != left or end >= n or symbols[end] != right:
            continue  # one of the two was merged meanwhile
        symbols[at], symbols[end] = new, -1
        count -= 1
        after[at] = beyond = after[end]
        if beyond < n:
            before[beyond] = at
            if r := ranks.get((new, symbols[beyond])):
                heapq.heappush(heap, (*r, at, new, symbols[beyond]))
        if (ahead := before[at]) >= 0 and (r := ranks.get((symbols[ahead], new))):
            heapq.heappush(heap, (*r, ahead, symbols[ahead], new))
    return count


def counter(tokenizer: dict):
    """text -> tokens."""
    ranks, single = tokenizer["ranks"], tokenizer["bytes"]
    pieces = regex.compile(PIECES).findall
    added = regex.compile("|".join(map(regex.escape, tokenizer["added"]))) if tokenizer["added"] else None

    class Counts(dict):
        def __missing__(self, piece):
            if len(self) >= KEPT:
                self.clear()
            n = merged_count([single[b] for b in piece.encode()], ranks)
            if len(piece) <= 64:
                self[piece] = n
            return n

    known = Counts().__getitem__

    def count(text: str) -> int:
        if added is None:
            return sum(map(known, pieces(text)))
        parts = added.split(text)
        return len(parts) - 1 + sum(sum(map(known, pieces(p))) for p in parts)

    return count


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per input row: id, n_bytes, n_tokens, over_limit. A null text is empty and has no tokens.

    path: the tokenizer's .json file, read by the driver. Strings of added tokens inside texts
    count as one token each, as the tokenizer treats them by default.
    """
    with open(path, encoding="utf-8") as file:
        tokenizer = read_tokenizer(file.read())
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        count = counter(shared.value)
        for batch in batches:
            text = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.compute.cast(pa.compute.binary_length(text.cast(pa.binary())), pa.int64()), pa.array([count(t) for t in text.to_pylist()], pa.int64())],
                ["doc", "n_bytes", "n_tokens"],
            )

    own = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    counted = own.mapInArrow(run, f"doc {dict(own.dtypes)['doc']}, n_bytes long, n_tokens long")
    return counted.select(F.col("doc").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


