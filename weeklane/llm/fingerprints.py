"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch holds every hash of its distinct five-word shingles that lies below a fixed share of
the hash range, so that it grows with the text, sketches of parts merge by union, and the share
of a small sketch that a large one holds estimates how much of the small text the large one contains.
A text none of whose hashes lies below the share keeps its smallest one; a text of fewer than
five words is one shingle; without words the sketch is empty. Null texts are empty. Words are
separated by blanks, A-Z count as a-z. Equal texts have equal sketches, whatever their rows.

All of it are DataFrame functions. The next document of each row is found on ids alone: rows are
sorted by ranges of the id, each row takes its successor within its range, and the last row of a
range the first of the next range. Rows that repeat an id follow one another by a hash of their
text, then by their place; a null id comes last. Texts then meet by row keys, which are unique, so
no key is hot: a text is shuffled once, and only the part of it that the edit needs goes on.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weeklane.llm.common import cut, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"  # all but the first become the first
DIGITS = 15  # hexadecimal, of a hash
SHINGLE = 5
SHARE = 1 / 8


def words(text: Column) -> Column:
    plain = F.translate(text, UPPER + BLANKS[1:], LOWER + BLANKS[0] * (len(BLANKS) - 1))
    return F.filter(F.split(plain, BLANKS[0]), lambda w: w != "")


def sketched(df: DataFrame, text: Column, out: str, share: float = SHARE, shingle: int = SHINGLE) -> DataFrame:
    """df with the sketch of a text that isn't null, as sorted whole numbers below 16**DIGITS."""
    w, h, k = f"_w_{out}", f"_h_{out}", f"_k_{out}"
    limit = f"{min(int(share * 16**DIGITS), 16**DIGITS - 1):0{DIGITS}x}"
    many = F.greatest(F.size(w) - shingle + 1, F.lit(1))
    each = F.transform(F.sequence(F.lit(1), many), lambda i: F.substring(F.md5(F.array_join(F.slice(F.col(w), i, shingle), " ")), 1, DIGITS))
    named = df.withColumn(w, words(text)).withColumn(h, F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<string>")))
    named = named.withColumn(k, F.filter(h, lambda x: x < limit))
    kept = F.when((F.size(k) > 0) | (F.size(h) == 0), F.col(k)).otherwise(F.array(F.array_min(h)))
    return named.withColumn(out, F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.conv(x, 16, 10).cast("long"))))).drop(w, h, k)


def written(sketch: Column) -> Column:
    """The sketch as one string: its hashes in order, each of DIGITS hexadecimal digits."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the distinct shingles of both that both have; 1 for equal sketches."""
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)))


def contained(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 0 for an empty sketch."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)).cast("double") / F.size(a)).otherwise(0.0)


def merged(sketches: Column) -> Column:
    """The sketch of several texts together, from an array of theirs; exact but for texts that kept a hash above the share."""
    return F.array_sort(F.array_distinct(F.flatten(sketches)))


def fingerprinted(df: DataFrame, text_col: str = "text", out: str = "sketch", share: float = SHARE, shingle: int = SHINGLE) -> DataFrame:
    return sketched(df, text_of(text_col), out, share, shingle)


def keyed(df: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns with a key per row that every scan gives alike: hash of its file, place in it.

    Rows that come from elsewhere than files are written first.
    """
    try:
        return df.select(F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("key"), *columns)
    except AnalysisException:
        return keyed(cut(df.select(*columns), "documents"), [F.col(c) for c in df.select(*columns).columns])


def successors(df: DataFrame) -> DataFrame:
    """df (key, id, tie, ...) with next, the key of the row after it by falling id; after the last comes the first."""
    order = [F.desc_nulls_last("id"), F.asc("tie"), F.asc("key")]
    placed = cut(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("range").orderBy(*order)
    rows = placed.select("*", F.lead("key").over(within).alias("_after"), F.row_number().over(within).alias("_k"))
    firsts = rows.where("_k = 1").select("range", "key")  # one row a range
    ring = Window.orderBy("range")
    following = firsts.select("range", F.coalesce(F.lead("key").over(ring), F.first("key").over(ring)).alias("_first"))
    return rows.join(F.broadcast(following), "range").select(*df.columns, F.coalesce("_after", "_first").alias("next"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, shingle: int = SHINGLE) -> DataFrame:
    """Per row its id, n_chars, fingerprint, and how like it are its edited text and the next document's text.

    The edited text has its last third (rounded down, in code points) replaced by as much of the
    start of the next document by falling id. contained_edited and contained_next: the share of the
    row's shingles that they hold.
    """
    own = keyed(docs, [F.col(id_col).alias("id"), text_of(text_col).alias("text")])
    linked = successors(own.select("key", "id", F.md5("text").alias("tie"), F.length("text").cast("long").alias("n_chars")))
    texts = sketched(own.select("key", "text"), F.col("text"), "sketch", share, shingle)
    third = F.expr("CAST(n_chars div 3 AS INT)")
    asked = linked.select(F.col("next").alias("key"), F.col("key").alias("of"), third.alias("third"))
    heads = texts.join(asked, "key").select(F.col("of").alias("key"), F.expr("substring(text, 1, third)").alias("head"), F.col("sketch").alias("next_sketch"))
    rows = texts.join(linked.select("key", "id", "n_chars"), "key").join(heads, "key")
    new = F.concat(F.expr("substring(text, 1, CAST(n_chars - n_chars div 3 AS INT))"), F.col("head"))
    rows = sketched(rows.select("id", "n_chars", "sketch", "next_sketch", new.alias("edit")), F.col("edit"), "edit_sketch", share, shingle)
    a, b, c = F.col("sketch"), F.col("edit_sketch"), F.col("next_sketch")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edit", 256).alias("edited_sha256"), written(a).alias("fingerprint"), written(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), contained(a, b).alias("contained_edited"), contained(a, c).alias("contained_next"),
    )
