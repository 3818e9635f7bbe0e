"""Balanced label propagation: equal texts move to one shard, and every shard gets as many rows.

Only DataFrame functions run here. Documents with equal texts are linked. A group of equal texts is held as at most
1024 cells (the documents of the group whose id hashes alike), so that no step sees a row per copy; a group that
exceeds a shard's quota is propagated as several pieces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CELLS = 1024
#: Rounds in a row without a smaller cut after which propagation ends.
PATIENCE = 3


def _of(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index + 1)


def label_propagation_shards(docs: DataFrame, shards: int = 16, rounds: int | None = None, slack: float = 1.0) -> DataFrame:
    """Shard and slot of each row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: the shards' row counts are at most one apart. size is the text's UTF-8 bytes plus 1, of a null text 1;
    a null text counts as empty. Rows that agree in all columns get different slots. An empty table gives no rows.
    Null ids are ids like others. Other columns are ignored.

    Each round counts, for each piece of a group, the documents in each shard (the neighbours' labels), takes the
    shard with most, and moves the others there while the quota has room: where more want in than fit, the hash of
    the group decides. Rounds end if none wants to move, if the cut has not become smaller for PATIENCE rounds, or after
    `rounds`, if given; the labels of the smallest cut count. The rest is exact arithmetic on ranks: what exceeds a shard's
    quota, and all documents without a link, fill the room that is left.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"))
    base = common.table(base.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(CELLS)).cast("int")), "shard-base")
    group = ["g", "size", "text_crc32"]
    rows = base.count()
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    cells = base.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("m"))
    sizes = cells.groupBy(*group).agg(F.sum("m").alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / F.lit(max(1, rows // shards)))
    cells = cells.join(sizes, group).select(*group, "cell", "m", (F.col("cell") % shards).alias("shard"), F.pmod(F.floor(F.col("cell") / shards), pieces).alias("piece"))
    cells = common.table(cells, "shard-cells")
    quota = [max(1, int(x * slack)) for x in room]

    def load(df: DataFrame) -> tuple[list[int], float]:
        """Documents by shard, and the pairs of equal texts that stay together once what exceeds a quota has left."""
        votes = df.groupBy(*group, "shard").agg(F.sum("m").alias("v"))
        held = {r.shard: r for r in votes.groupBy("shard").agg(F.sum("v").alias("n"), F.sum(F.col("v").cast("double") * F.col("v")).alias("pairs")).collect()}
        return [int(held[s].n) if s in held else 0 for s in range(shards)], sum(r.pairs * min(1.0, room[s] / r.n) ** 2 for s, r in held.items())

    held, whole = load(cells)
    best_cells, best_held, idle, k = cells, held, 0, 0
    while idle < PATIENCE and (rounds is None or k < rounds):
        votes = cells.groupBy(*group, "piece", "shard").agg(F.sum("m").alias("v"))
        tie = F.struct("v", F.xxhash64("g", "shard", F.lit(k)))
        best = votes.groupBy(*group, "piece").agg(F.max_by("shard", tie).alias("to"))
        asked = common.table(cells.join(best, [*group, "piece"]), "shard-asked")
        wants = {r.to: r.n for r in asked.where("to <> shard").groupBy("to").agg(F.sum("m").alias("n")).collect()}
        leaves = {r.shard: r.n for r in asked.where("to <> shard").groupBy("shard").agg(F.sum("m").alias("n")).collect()}
        if not wants:
            break
        # a shard has room for what its quota leaves and, in part, for what moves out meanwhile
        share = [min(1.0, max(0.0, (quota[s] - held[s] + 0.5 * leaves.get(s, 0)) / wants[s])) if wants.get(s) else 1.0 for s in range(shards)]
        luck = F.pmod(F.xxhash64(*group, "piece", F.lit(1000 + k)), F.lit(1 << 20)) / float(1 << 20)
        cells = asked.withColumn("shard", F.when(luck < _of(share, F.col("to")), F.col("to")).otherwise(F.col("shard"))).drop("to")
        cells = common.table(cells, "shard-cells")
        held, now = load(cells)
        k += 1
        if now > whole:
            best_cells, best_held, whole, idle = cells, held, now, 0
        else:
            idle += 1

    cells, held = best_cells, best_held
    linked = cells.select(*group, "cell", F.col("shard").cast("int").alias("part"))
    placed = base.join(linked, [*group, "cell"], "left").withColumn("part", F.coalesce("part", F.lit(-1)))
    placed = common.ranked(placed, ["part"], [*group, "cell"], [*group, "doc_id"], rows, "rank")
    kept = [min(h, r) for h, r in zip(held, room)]
    over = [h - k for h, k in zip(held, kept)]
    single = rows - sum(held)
    ahead = lambda xs: [sum(xs[:i]) for i in range(len(xs))]
    left = [r - k for r, k in zip(room, kept)]
    part, rank = F.greatest("part", F.lit(0)), F.col("rank")
    stays = (F.col("part") >= 0) & (rank < _of(kept, part))
    pool = F.when(F.col("part") < 0, rank).otherwise(single + _of(ahead(over), part) + rank - _of(kept, part))
    starts = ahead(left)
    fills = reduce(lambda x, s: F.when((F.col("pool") >= starts[s]) & (F.col("pool") < starts[s] + left[s]), s).otherwise(x), range(shards), F.lit(None).cast("int"))
    out = placed.withColumn("stays", stays).withColumn("pool", F.when(~stays, pool)).withColumn("fill", fills)
    shard = F.when(F.col("stays"), F.col("part")).otherwise(F.col("fill")).cast("int")
    slot = F.when(F.col("stays"), rank).otherwise(_of(kept, F.col("fill")) + F.col("pool") - _of(starts, F.col("fill")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
