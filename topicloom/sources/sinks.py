"""Writers of fitted models, as Parquet tables and as dense CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(model: dict[str, DataFrame], out: str) -> None:
    """Each table under its name, those with a shard column partitioned by it."""
    for name, df in model.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("shard") if "shard" in df.columns else writer).parquet(f"{out}/{name}")


def dense_csv(counts: DataFrame, row: str, column: str, value: str, columns: int, out: str) -> None:
    """A text line of `columns` comma-parted values for each row key, in its order; absent cells are 0."""
    cell = F.map_from_entries(F.collect_list(F.struct(F.col(column).cast("int"), F.col(value).cast("double"))))
    lines = counts.groupBy(row).agg(cell.alias("m"))
    line = F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.format_string("%.18e", F.coalesce(F.element_at("m", c), F.lit(0.0)))))
    lines.select(row, line.alias("value")).orderBy(row).select("value").write.mode("overwrite").text(out)


def dense_shards(counts: DataFrame, row: str, column: str, value: str, columns: int, out: str, rows: DataFrame | None = None) -> None:
    """Lines as of dense_csv, for all shards in one write: out/shard=<label>/, in order of the row key. rows: (shard, row)
    that must have a line, of zeros if they have no counts."""
    cell = F.map_from_entries(F.collect_list(F.struct(F.col(column).cast("int"), F.col(value).cast("double"))))
    lines = counts.groupBy("shard", row).agg(cell.alias("m"))
    if rows is not None:
        have = lines.select(F.col("shard").alias("_s"), F.col(row).alias("_r"), "m")
        lines = rows.join(have, F.col("shard").eqNullSafe(F.col("_s")) & (F.col(row) == F.col("_r")), "left").select("shard", row, "m")
    number = lambda c: F.format_string("%.18e", F.coalesce(F.element_at("m", c), F.lit(0.0)))
    line = F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), number))
    _ordered(lines.select("shard", row, line.alias("value")), row, out)


def column_shards(values: DataFrame, row: str, value: str, out: str) -> None:
    """A line for each row of each shard: out/shard=<label>/, in order of the row key."""
    _ordered(values.select("shard", row, F.format_string("%.18e", F.col(value).cast("double")).alias("value")), row, out)


def _ordered(lines: DataFrame, row: str, out: str) -> None:
    dealt = lines.repartitionByRange("shard", row).sortWithinPartitions("shard", row)
    dealt.select("shard", "value").write.mode("overwrite").partitionBy("shard").text(out)


def read_fixed_counts(spark, path: str) -> DataFrame:
    """(k, term_id, n) from lines of comma-parted counts without header; the line's place in the file is k."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace(F.rtrim("value"), "\r", ""), "\n")).alias("k", "line"))
    cells = lines.where(F.trim("line") != "").select("k", F.posexplode(F.split("line", ",")).alias("term_id", "x"))
    return cells.select("k", "term_id", F.trim("x").cast("double").cast("long").alias("n"))
