"""Online fits over a stream of triplet files: state is a table of counts by shard, a batch's shards go in natural order."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sweep import Config
from ..plans.fit import online_step, place

log = logging.getLogger("topicloom")


def start_online(stream: DataFrame, terms: DataFrame, cfg: Config, out: str, checkpoint: str, niters: int = 1, omega: float = 1.0):
    """A running query that fits each shard as it arrives and writes out/nw_hist/t=... and out/z/t=....

    stream: shard, entry_id, doc_id, term_id, count; a shard must arrive within one batch, and a later batch with more of
    it is an error. Shards before the last one done, in natural order, are late: they are logged and kept in
    out/late/batch=..., and no fit has them. A batch that is run again, told by its number, overwrites its own shards.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        done = known(spark, out)
        last = place(done[-1][1]) if done else ()
        late = []
        for label in sorted((r.shard for r in df.select("shard").distinct().collect()), key=place):
            again, of = next(((t, n) for t, l, n in done if l == label), (None, None))
            if again is not None and of != number:
                raise ValueError(f"shard {label!r} came in batch {of} and again in batch {number}")
            if again is None and done and place(label) < last:
                late.append(label)
                continue
            t = len(done) if again is None else again
            history = history_of(spark, out).where(F.col("t") < t) if t else None
            state, own, _ = online_step(df.where(F.col("shard").eqNullSafe(F.lit(label))), terms, cfg, t, history, niters, omega)
            own = own.drop("t").withColumns({"shard": F.lit(label).cast("string"), "batch": F.lit(number).cast("long")})
            own.write.mode("overwrite").parquet(f"{out}/nw_hist/t={t}")
            state.write.mode("overwrite").parquet(f"{out}/z/t={t}")
            if again is None:
                done.append((t, label, number))
                last = place(label)
        if late:
            rows = df.where(F.coalesce(F.col("shard").isin([x for x in late if x is not None]), F.lit(None in late)))
            rows.write.mode("overwrite").parquet(f"{out}/late/batch={number}")
            log.warning("batch %d: %d shards came too late: %s", number, len(late), ", ".join(map(str, late)))
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_of(spark: SparkSession, out: str) -> DataFrame:
    """(t, k, term_id, n) of the shards that are done."""
    return spark.read.parquet(f"{out}/nw_hist").select("t", "k", "term_id", "n")


def known(spark: SparkSession, out: str) -> list[tuple[int, str, int]]:
    """(t, label, batch) of the shards that are done."""
    try:
        rows = spark.read.parquet(f"{out}/nw_hist").select("t", "shard", "batch").distinct().collect()
    except Exception as e:  # no shard has been written yet
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted(((r.t, r.shard, r.batch) for r in rows), key=lambda r: r[0])
