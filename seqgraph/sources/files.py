"""Text sources with counted errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated eco, name, pgn; rows without moves are left out."""
    return spark.read.csv(path, sep="\t", header=True, schema="eco string, name string, pgn string").where("pgn IS NOT NULL AND trim(pgn) <> ''")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines): what can't be read is kept and counted, not dropped."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where("trim(value) <> ''").select("value", parsed.alias("row"))
    return rows.where("row._bad IS NULL").select("row.*").drop("_bad"), rows.where("row._bad IS NOT NULL").select(F.col("value").alias("line"))


def read_queue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.json(path, multiLine=True, schema=schema)


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines in order; range-partitioned, so the files' order is the rows' order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str, *order: str) -> None:
    """Appends rows to a CSV log; each part has the header, which readers with a header skip."""
    rows.sortWithinPartitions(*order).write.mode("append").csv(path, header=True) if order else rows.write.mode("append").csv(path, header=True)


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """A report as json, csv (with a header) or markdown: a table of text lines, in the order of the rows given."""
    if kind == "markdown":
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), r"\n", " ") for c in cells]), F.lit(" |"))
        head = rows.sparkSession.createDataFrame([(0, f"| {' | '.join(rows.columns)} |"), (1, "|" + "-|" * len(rows.columns))], "at long, value string")
        # a report is a page: its rows are written by one task, in their order
        body = rows.select((F.monotonically_increasing_id() + 2).alias("at"), line.alias("value"))
        head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
    elif kind in ("json", "csv"):
        getattr(rows.write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {})), kind)(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def lookup(rows: DataFrame, **keys) -> list:
    """The rows with these key values; the filters reach the files' statistics."""
    for name, value in keys.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows.collect()
