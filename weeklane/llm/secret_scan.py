"""Secrets in texts, judged by how widely their value is copied over the corpus.

Patterns give spans of three kinds. Further candidates are long strings that look like generated
credentials. Every candidate's value is hashed and counted over the corpus: the repositories
(documents) and owners (sources) that hold it. Values that many owners hold are copied examples; a
candidate whose value one owner alone holds, in however many documents, is taken for a live
credential and its span is added, kind ``owned``. Spans of the patterns stay whatever the count, marked by it.
"""

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weeklane.llm.common import cut, text_of

KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, LONG = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}", "[A-Za-z0-9+/_-]{20,}"
FOUND = "array<struct<start:int,kind:int,end:int,low:int,value:long>>"


def looks_generated(value: str, entropy: float) -> bool:
    """Upper and lower letters and digits, and at least so many bits of entropy a character."""
    if not (re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= entropy


def scan(text: str, entropy: float) -> list[tuple]:
    """(start, kind, end, start of the value, its hash), by start, then kind."""
    spans = []
    for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end(), m.start(2), m[2]))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        spans += [(m.start(), kind, m.end(), m.start(), m[0]) for m in re.finditer(pattern, text)]
    taken = sorted((s[0], s[2]) for s in spans)
    at = 0
    for m in re.finditer(LONG, text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if (at == len(taken) or taken[at][0] >= m.end()) and looks_generated(m[0], entropy):
            spans.append((m.start(), 3, m.end(), m.start(), m[0]))
    return [(*s[:4], xxhash.xxh3_64_intdigest(s[4]) - (1 << 63)) for s in sorted(spans)]


def scanned(docs: DataFrame, entropy: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "found")}
            for t in batch.column("text").to_pylist():
                spans = scan(t, entropy)
                for k, name in enumerate(KINDS[:3]):
                    out[f"n_{name}"].append(sum(s[1] == k for s in spans))
                out["base_sha256"].append(hashlib.sha256(",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans if s[1] < 3).encode()).hexdigest())
                out["found"].append([dict(zip(("start", "kind", "end", "low", "value"), s, strict=True)) for s in spans])
            found = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("low", pa.int32()), ("value", pa.int64())]))
            kinds = [pa.int64()] * 3 + [pa.string(), found]
            cols = [batch.column(c) for c in ("row", "doc", "owner")] + [pa.array(out[k], t) for k, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc", "owner", *out])

    doc = dict(docs.dtypes)["doc"]
    return docs.select("row", "doc", "owner", "text").mapInArrow(run, f"row long, doc {doc}, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", entropy: float = 3.5, owners: int = 1) -> DataFrame:
    """Per input row: id, n_assign, n_access, n_hex, base_sha256, spans (array of start, kind,
    end, low, live, docs, by start, then kind; low is where the secret itself starts, docs the documents
    that hold the value).

    live: at most ``owners`` owners hold the value; copies within an owner don't make it public. Of kind owned,
    only live spans are returned. A null text is empty, a null owner is an owner of its own, and
    repeated rows are documents of their own.
    """
    own = docs.select(F.col(id_col).alias("doc"), F.col(owner_col).cast("string").alias("owner"), text_of(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    seen = cut(scanned(own, entropy), "secrets")
    each = seen.where(F.size("found") > 0).select("row", "owner", F.inline("found"))
    held = each.select("value", "owner", "row").distinct().groupBy("value", "owner").agg(F.count("*").alias("docs")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("docs").alias("docs"))
    judged = each.join(held, "value").withColumn("live", F.col("owners") <= owners).where("live or kind < 3")
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "low", "live", "docs"))).alias("spans"))
    out = seen.select("row", "doc", "n_assign", "n_access", "n_hex", "base_sha256").join(spans, "row", "left")
    return out.withColumnRenamed("doc", id_col).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,low:int,live:boolean,docs:bigint>>"))).drop("row")


def redacted(text: Column, spans: Column) -> Column:
    """The text with the secret of each span replaced by [secret]; overlapping ones once."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(done, s):
        more = F.concat(done["text"], F.substring(text, done["at"] + 1, s["low"] - done["at"]), F.lit("[secret]"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["low"] >= done["at"], more).otherwise(done["text"]).alias("text"))

    return F.aggregate(spans, start, step, lambda d: F.concat(d["text"], F.substring(text, d["at"] + 1, F.length(text))))


def span_text(spans: str = "spans"):
    """The spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])))
