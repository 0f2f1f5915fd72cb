"""Mixing sources to target weights by weighted fair queueing.

Each document stands in its source's queue once per pass, in an order shuffled by a hash. Its
virtual finish time is the source's words up to and with it, over the source's weight. All
instances are sorted by that time, by range, and the mix ends where its words reach the budget:
at the virtual time T at which the queues have served the budget, sum(min(passes * size,
weight * T)) = budget. A queue that runs dry leaves its share to the others by weight. The instance
that a queue is serving at T is taken up to T, by words.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weeklane.llm.common import cut

SLOTS = 4096  # parts of a source's queue, and of the virtual time line, that are summed first


def word_count(c):
    return F.size(F.regexp_extract_all(c, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).cast("long")


def queues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", key_col: str | None = None) -> DataFrame:
    """Per row: doc, source, size (words; a null text has none) and its shuffled place's hash, of
    key_col (the id if none is given)."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key_col or id_col).cast("string"), F.lit(""))))
    size = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(word_count(F.col(text_col))).cast("long")
    return docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), size.alias("size"), key.alias("u"))


def targets(queue: DataFrame, weights: tuple, share: float, passes: int) -> DataFrame:
    """Per source: source_size, weight, target and finish (T). One row per source, aggregated before."""
    own = queue.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)).cast("double"))
    dry = ranked.withColumn("dry", passes * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("dry", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum(passes * F.col("source_size")).over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = dry.withColumn("level", level).withColumn("turn", F.row_number().over(Window.orderBy("dry", F.col("source").asc_nulls_last())))
    first = F.min(F.when(F.col("level") <= F.col("dry"), F.struct("turn", "level"))).over(whole)  # the first queue that doesn't run dry
    timed = ranked.withColumn("finish", first.getField("level"))
    target = F.least(passes * F.col("source_size").cast("double"), F.col("weight") * F.col("finish"))  # no finish: all is taken
    return timed.select("source", "source_size", "weight", target.alias("target"), F.coalesce("finish", F.max("dry").over(whole)).alias("finish"))


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: str = "mix", **names) -> tuple[DataFrame, DataFrame]:
    """(queue rows with source_size and target, instances that the mix takes).

    Instances: doc, source, u, size, pass, virtual_finish, taken, and position, the words of the
    mix before it in the order of virtual finish. Sources are ordered by code point, null last;
    weights repeat in that order. A null text and an empty one have size 0 and no instance. Ties
    of the hash go by id, then size; repeated rows are instances of their own. If the budget is
    above passes times all words, everything is taken. An empty table gives empty results.
    """
    queue = cut(queues(docs, seed=seed, **names), "queues").withColumn("slot", F.conv(F.substring("u", 1, 3), 16, 10).cast("int"))
    of = cut(targets(queue, weights, share, passes), "targets")
    some = queue.where("size > 0")
    slots = some.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    slots = slots.withColumn("before", F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot")) - F.col("slot_size"))
    place = Window.partitionBy("source", "slot").orderBy("u", "doc", "size").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("q.source").eqNullSafe(F.col("s.source"))
    lined = (
        some.withColumn("in_slot", F.sum("size").over(place)).alias("q")
        .join(slots.alias("s"), same & (F.col("q.slot") == F.col("s.slot"))).select("q.doc", "q.source", "q.u", "q.size", (F.col("before") + F.col("in_slot")).alias("upto"))
    )
    lined = lined.alias("q").join(of.alias("s"), same).select("q.*", "s.source_size", "s.weight", "s.target", "s.finish")
    served = lined.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("upto", F.col("upto") + F.col("pass") * F.col("source_size"))
    limit = F.floor("target").cast("long")
    taken = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), limit - (F.col("upto") - F.col("size"))))
    served = served.withColumn("taken", taken).where("taken > 0").withColumn("virtual_finish", F.col("upto") / F.col("weight"))
    served = served.withColumn("at", F.least(F.floor(F.col("virtual_finish") / F.col("finish") * SLOTS), F.lit(SLOTS)).cast("int"))
    lines = served.groupBy("at").agg(F.sum("taken").alias("line"))
    lines = lines.withColumn("ahead", F.sum("line").over(Window.orderBy("at")) - F.col("line"))
    order = Window.partitionBy("at").orderBy("virtual_finish", F.col("source").asc_nulls_last(), "u", "doc", "upto").rowsBetween(Window.unboundedPreceding, 0)
    placed = served.withColumn("in_line", F.sum("taken").over(order)).join(lines, "at").withColumn("position", F.col("ahead") + F.col("in_line") - F.col("taken"))
    columns = ["doc", "source", "u", "size", "pass", "virtual_finish", "taken", "position"]
    return queue.alias("q").join(of.alias("s"), same).select("q.doc", "q.source", "q.u", "q.size", "s.source_size", "s.target"), placed.select(*columns)


def mixed_words(docs: DataFrame, **settings) -> DataFrame:
    """Per input row: doc, source, size, source_size, target, taken (over all passes)."""
    queue, served = mix(docs, **settings)
    by = ["doc", "source", "u", "size"]
    counted = queue.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("target")))
    got = served.withColumn("n", F.row_number().over(Window.partitionBy(*by, "pass").orderBy("virtual_finish"))).groupBy(*by, "n").agg(F.sum("taken").alias("taken"))
    same = [F.col(f"q.{c}").eqNullSafe(F.col(f"g.{c}")) for c in [*by, "n"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return counted.alias("q").join(got.alias("g"), on, "left").select("q.doc", "q.source", "q.size", "q.source_size", "q.target", F.coalesce("g.taken", F.lit(0).cast("long")).alias("taken"))
