"""URL rules by a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 the keys of the corpus that level 1 takes for listed and
that aren't; level 3 the listed keys that level 2 takes for the others, and so on until no key is
mistaken. Over the keys it was built with, which are all keys of the corpus, the answer is exact,
and judging a url needs no join. Level 1 has about 1.44 * log2(keys / listed) bits for a listed
key and the others a few more, so that all levels together stay in proportion to the list.

A key is a rule's host and path as one text. A url's keys are its host's last labels with its
path's first characters, for each (labels, characters) shape that occurs in the list.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weeklane.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 4  # at most, of a level


def positions(key: Column, level: int, k: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(k)]


def contains(key: Column, level: int, k: int, bits: int, data: bytearray) -> Column:
    """Whether the level takes the key for one of its own."""
    hit = F.lit(True)
    for at in positions(key, level, k, bits):
        byte = F.conv(F.hex(F.substring(F.lit(data), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = hit & (F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return hit


def level_of(keys: DataFrame, n: int, level: int, rate: float) -> tuple:
    k = max(1, min(HASHES, round(-math.log2(rate))))
    bits = 8 * math.ceil(max(8.0, -k * n / math.log(1 - rate ** (1 / k))) / 8)
    at = F.explode(F.array(*positions(F.col("key"), level, k, bits)))
    found = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("at", F.lit(8)).cast("int"))).alias("set")).collect()  # at most bits / 8 rows
    data = bytearray(bits // 8)
    for r in found:
        data[r["byte"]] = r["set"]
    return level, k, bits, data


def cascade(listed: DataFrame, universe: DataFrame) -> list[tuple]:
    """Levels over distinct listed keys and all distinct keys of the corpus (column key)."""
    listed = listed.select("key").where("key is not null").distinct()
    inside, outside = cut(listed, "listed"), cut(universe.select("key").join(listed, "key", "left_anti"), "unlisted")
    n, others, levels = inside.count(), outside.count(), []
    rate = min(0.5, math.sqrt(0.5) * n / max(others, 1))
    while n:
        levels.append(level_of(inside, n, len(levels), max(rate, 1e-12)))
        mistaken = cut(outside.where(contains(F.col("key"), *levels[-1])), "mistaken")
        inside, outside, n, rate = mistaken, inside, mistaken.count(), 0.5
    return levels


def member(key: Column, levels: list[tuple]) -> Column:
    """Exact for every key of the corpus; null keys are never members."""
    out = F.lit(len(levels) % 2 == 1)
    for at in reversed(levels):
        out = F.when(contains(key, *at), out).otherwise(F.lit(at[0] % 2 == 1))
    return F.coalesce(out & key.isNotNull(), F.lit(False))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end. Else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per input row: id, host, path, rule (the longest that fits, else null) and verdict.

    rules: host, path, verdict ('allow' or 'block'); a rule listed with both blocks. Of the rules
    that fit, the one with the longest host, then path, wins. A url that no rule fits is unlisted:
    the cascade's answer is the default. A null url and one without :// have an empty host and path.
    """
    rules = rules.select(F.col("host"), F.col("path"), "verdict").distinct()
    shapes = sorted(tuple(r) for r in rules.select(F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect())
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"))

    def key(labels: int, chars: int) -> Column:
        return F.when((F.length("path") >= chars) & (F.col("host") != ""), F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))

    keys = own.select(F.explode(F.array(*[key(*s) for s in shapes])).alias("key")).where("key is not null").distinct() if shapes else own.select(F.col("host").alias("key")).limit(0)
    universe = cut(keys, "keys")
    listed = {v: cascade(rules.where(F.col("verdict") == v).select(F.concat("host", "path").alias("key")), universe) for v in ("allow", "block")}
    found = F.lit(None).cast("struct<labels:int,chars:int,rule:string,verdict:string>")
    for s in shapes:
        for v in ("allow", "block"):
            one = F.struct(F.length(F.substring_index("host", ".", -s[0])).alias("labels"), F.lit(s[1]).alias("chars"), key(*s).alias("rule"), F.lit(v).alias("verdict"))
            found = F.greatest(found, F.when(member(key(*s), listed[v]), one))
    return own.withColumn("found", found).select(
        F.col("page").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict")
    )
