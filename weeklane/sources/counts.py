"""Wide count tables to tidy counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weeklane.config import COUNT_NODES, GEO, KEPT_NODES, NAME, TARGET_WEEK, TRUTH_NODES, VALUE, WEEK
from weeklane.functions.scalars import clip, monday, monday_by_weekday, normalize_text, number, parse_day
from weeklane.sources.sinks import staged


def read_text_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header, all columns as text: values are converted leniently later, without an inference pass."""
    return spark.read.option("header", True).csv(path)


MALFORMED = "_malformed"


def read_checked_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``read_text_csv``, with the whole line in ``_malformed`` where it has more or fewer fields than the header.

    Such lines stay in the result, as far as they can be read, so that they can be counted and mended.
    """
    names = read_text_csv(spark, path).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, MALFORMED])
    return spark.read.option("header", True).option("columnNameOfCorruptRecord", MALFORMED).schema(schema).csv(path)


def line_counts(checked: DataFrame) -> DataFrame:
    """(n_lines, n_malformed) of ``read_checked_csv``. The parsed lines are written first: a line is only known to be malformed once all of it is parsed."""
    return staged(checked, "lines").agg(F.count(F.lit(1)).alias("n_lines"), F.count(MALFORMED).alias("n_malformed"))


def _known(df: DataFrame, nodes: Mapping[str, object]) -> dict[str, str]:
    """Source column -> normalised name, for the columns the mapping knows."""
    return {c: n for c in df.columns if (n := normalize_text(c)) in nodes}


def unpivot_counts(
    wide: DataFrame,
    nodes: Mapping[str, tuple[str, str]] = COUNT_NODES,
    keep: tuple[str, ...] | None = KEPT_NODES,
    date_col: str = "date",
) -> DataFrame:
    """One row per node and week: unreadable values dropped, fractions cut, negatives set to 0."""
    if date_col not in wide.columns:
        raise ValueError(f"no date column {date_col!r} among {wide.columns}")
    known = _known(wide, nodes)
    if not known:
        raise ValueError(f"none of the columns {wide.columns} is a known count column")
    day = F.col(date_col)
    week = monday(parse_day(day) if dict(wide.dtypes)[date_col] == "string" else day)
    entries = F.array(
        *[
            F.struct(
                F.lit(nodes[n][0]).alias(GEO),
                F.lit(nodes[n][1]).alias(NAME),
                clip(number(c).try_cast("long"), 0).alias(VALUE),
            )
            for c, n in known.items()
            if keep is None or nodes[n][0] in keep
        ]
    )
    rows = wide.select(week.alias(WEEK), F.inline(entries))
    return rows.na.drop("any", subset=[WEEK, VALUE]).select(GEO, NAME, WEEK, VALUE)


def load_counts(spark: SparkSession, path: str, date_col: str = "date", **kw) -> DataFrame:
    return unpivot_counts(read_text_csv(spark, path), date_col=date_col, **kw)


def melt_truth(wide: DataFrame, nodes: Mapping[str, str] = TRUTH_NODES, date_col: str = "date") -> DataFrame:
    """Truth per node and target week; every node of the mapping must be present."""
    by_name = {c.lower(): c for c in wide.columns}
    absent = [n for n in nodes if n not in by_name]
    if absent:
        raise KeyError(f"missing columns: {absent}")
    entries = F.array(
        *[F.struct(F.lit(g).alias(GEO), number(by_name[n]).alias("y_true")) for n, g in nodes.items()]
    )
    day = F.col(date_col)
    day = parse_day(day) if dict(wide.dtypes)[date_col] == "string" else day
    return wide.select(monday_by_weekday(day).alias(TARGET_WEEK), F.inline(entries))
