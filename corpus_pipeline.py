"""Documents to a training mix: toxicity, near copies, contamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Rows, not ids,
are kept or dropped: rows that repeat an id, or have none, are documents of their own.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weeklane.llm.common import cut, small, table
from weeklane.llm.minhash import near_copies
from weeklane.llm.mixing import mixed_words
from weeklane.llm.secret_scan import redacted, secret_spans
from weeklane.llm.toxicity import toxicity
from weeklane.llm.winnowing import contamination

ROW, FILE, PLACE = "pipeline_row_number", "pipeline_file", "pipeline_place"
ROWS_OF_A_FILE = 1 << 40
LISTED = 500_000  # rows of ids, or spans, that may be broadcast; more are joined by a shuffle
REJECTED = 0.3  # toxicity from which a document goes


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number per row that every scan gives alike, and no other row has: of its file and its place there.

    Rows that come from elsewhere than files are written first.
    """
    try:
        own = docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))
    except AnalysisException:
        return numbered(cut(docs, "docs"))
    files = own.select(FILE).distinct().withColumn(ROW, F.row_number().over(Window.orderBy(FILE)).cast("long"))  # a row a file
    joined = own.join(small(cut(files, "files"), LISTED), FILE)
    return joined.select(*docs.columns, (F.col(ROW) * ROWS_OF_A_FILE + F.col(PLACE)).alias(ROW))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores below REJECTED; a null or empty text has the score of no words, as any other."""
    score = "pipeline_toxicity"
    learned = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    scored = toxicity(docs, table(spark, sf_dir, "labels"), learned, columns=docs.columns, score_col=score)
    return scored.where(F.col(score) < REJECTED).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the first in the files; rows without words are in no group and stay."""
    own = numbered(docs)
    gone = near_copies(own, ROW, shingle=5, percent=80).where("not keeper").select(ROW)
    return own.join(small(cut(gone, "gone"), LISTED), ROW, "left_anti").drop(ROW)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of which less than a twentieth of the words are hit; a null or empty text stays."""
    own = numbered(docs)
    gone = contamination(own, table(spark, sf_dir, "benchmark"), ROW).where("n_hit > 0 and 20 * n_hit >= n_words").select(ROW)
    return own.join(small(cut(gone, "gone"), LISTED), ROW, "left_anti").drop(ROW)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each found value replaced; n_chars follows the text where it changed. A null text stays null."""
    own = numbered(docs)
    found = cut(secret_spans(own, ROW).where(F.size("spans") > 0).select(ROW, F.col("spans").alias("pipeline_spans")), "spans")
    spans = found.agg(F.sum(F.size("pipeline_spans"))).first()[0] or 0
    joined = own.join(F.broadcast(found) if spans <= LISTED else found, ROW, "left")
    some = F.col("pipeline_spans").isNotNull()
    text = F.when(some, redacted(F.col("text"), F.col("pipeline_spans"))).otherwise(F.col("text"))
    return joined.withColumn("text", text).withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(ROW, "pipeline_spans")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with size (words) and taken (words that the mix takes)."""
    own = numbered(docs)
    taken = mixed_words(own, id_col=ROW, key_col="doc_id").where("taken > 0").select(F.col("doc").alias(ROW), "size", "taken")
    return own.select(*[c for c in own.columns if c not in ("size", "taken")]).join(small(cut(taken, "taken"), LISTED), ROW).drop(ROW)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
]

# Trained scores, minimum hashes and merged spans have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
