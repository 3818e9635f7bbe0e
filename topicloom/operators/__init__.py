"""Count tables and proportions, all of them queries over the table of assignments
(shard, entry_id, doc_id, term_id, count, z)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import draw, running, uniform


def zprior(terms: DataFrame, topics: int, beta: float, history: DataFrame | None = None) -> DataFrame:
    """(k, term_id, prior): beta, plus the counts of history (k, term_id, n) without decay."""
    grid = terms.select("term_id", F.explode(F.sequence(F.lit(0), F.lit(topics - 1))).alias("k"))
    if history is None:
        return grid.select("k", "term_id", F.lit(float(beta)).alias("prior"))
    summed = history.groupBy("k", "term_id").agg(F.sum("n").alias("n"))
    return grid.join(summed, ["k", "term_id"], "left").select("k", "term_id", (F.coalesce(F.col("n"), F.lit(0)) + F.lit(float(beta))).alias("prior"))


def zprob(prior: DataFrame) -> DataFrame:
    """(k, term_id, p): the prior over its sum for the term."""
    return prior.select("k", "term_id", (F.col("prior") / F.sum("prior").over(Window.partitionBy("term_id"))).alias("p"))


def init_z(entries: DataFrame, p: DataFrame, seed: int, *key: Column | str) -> DataFrame:
    """entries with z drawn from the term's probabilities p (k, term_id, p), with the uniform of key, sweep 0 and seed."""
    packed = p.groupBy("term_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x.p).alias("p"))
    packed = packed.select("term_id", running(F.col("p")).alias("_cumulative"))  # once a term, not once an entry
    z = draw(F.col("_cumulative"), uniform(*key, 0, seed)).cast("int")
    return entries.join(packed, "term_id").withColumn("z", z).drop("_cumulative")


def init_z_uniform(entries: DataFrame, topics: int, seed: int, *key: Column | str) -> DataFrame:
    """The same with equal probabilities, without a join."""
    cumulative, u = list(accumulate([1.0 / topics] * topics)), uniform(*key, 0, seed)
    if topics <= 32:  # plain comparisons are compiled, functions of arrays are not
        z = sum(((F.lit(c) <= u).cast("int") for c in cumulative[:-1]), F.lit(0))
    else:
        z = draw(F.array(*(F.lit(c) for c in cumulative)), u)
    return entries.withColumn("z", z.cast("int"))


def nd(entries: DataFrame) -> DataFrame:
    return entries.groupBy("shard", "doc_id", F.col("z").alias("k")).agg(F.sum("count").alias("n"))


def ndsum(entries: DataFrame) -> DataFrame:
    return entries.groupBy("shard", "doc_id").agg(F.sum("count").alias("n"))


def nw(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.col("z").alias("k"), "term_id").agg(F.sum("count").alias("n"))


def nwsum(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.col("z").alias("k")).agg(F.sum("count").alias("n"))


def dense(counts: DataFrame, keys: DataFrame, topics: int) -> DataFrame:
    """counts (key columns, k, n) on the grid of keys and topics, 0 where there is none."""
    grid = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(topics - 1))).alias("k"))
    return grid.join(counts, [*keys.columns, "k"], "left").na.fill(0, ["n"])


def tokens(entries: DataFrame) -> DataFrame:
    """A row of count 1 for each token, numbered anew within the shard; each starts with its entry's z, if there is one."""
    rows = entries.select("*", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy")).where("count > 0")
    order = Window.partitionBy("shard").orderBy("entry_id", "copy")
    return rows.withColumns({"entry_id": (F.row_number().over(order) - 1).cast("long"), "count": F.lit(1).cast("long")})


def prior_sums(documents: DataFrame, topics: int, terms: int, alpha: float, beta: float) -> DataFrame:
    """(kind, id, total): sums of constant priors over topics for each document, and over terms for each topic."""
    spark = documents.sparkSession
    docs = documents.select(F.lit("alpha").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.lit(float(topics * alpha)).alias("total"))
    return docs.union(spark.range(topics).select(F.lit("beta"), "id", F.lit(float(terms * beta))))


def theta(nd_dense: DataFrame, topics: int, alpha: float, prior: DataFrame | None = None) -> DataFrame:
    """(shard, doc_id, k, theta). prior (doc_id, k, a) replaces the constant."""
    df = nd_dense.withColumn("a", F.lit(float(alpha))) if prior is None else nd_dense.join(prior, ["doc_id", "k"])
    over = Window.partitionBy("shard", "doc_id")
    total = F.lit(float(topics * alpha)) if prior is None else F.sum("a").over(over)
    return df.select("shard", "doc_id", "k", ((F.col("n") + F.col("a")) / (F.sum("n").over(over) + total)).alias("theta"))


def phi(nw_dense: DataFrame, terms: int, beta: float, prior: DataFrame | None = None) -> DataFrame:
    """(k, term_id, phi). prior (k, term_id, b) replaces the constant. Topic sums are a row per topic, joined back."""
    df = nw_dense.withColumn("b", F.lit(float(beta))) if prior is None else nw_dense.join(prior, ["k", "term_id"])
    total = F.sum("n") + (F.lit(float(terms * beta)) if prior is None else F.sum("b"))
    return df.join(F.broadcast(df.groupBy("k").agg(total.alias("total"))), "k").select("k", "term_id", ((F.col("n") + F.col("b")) / F.col("total")).alias("phi"))


def merge(before: DataFrame, parts: DataFrame) -> DataFrame:
    """(1 - P) times the counts before, (k, term_id, n), plus those of P shards, (shard, k, term_id, n), each of which
    started from them. It equals the group-by of all assignments; this form is for shards kept elsewhere."""
    shards = parts.select("shard").distinct().count()
    rows = before.select("k", "term_id", (F.col("n") * (1 - shards)).alias("n")).union(parts.select("k", "term_id", "n"))
    return rows.groupBy("k", "term_id").agg(F.sum("n").alias("n"))


def decayed(history: DataFrame, omega: float, own: bool = True) -> DataFrame:
    """(t, k, term_id, n): for each time t the sum of omega^(t - s) times the counts of times s < t, and with own of t itself.

    history: (t, k, term_id, n). Each row is sent to the times after it, of which there are as many as shards.
    """
    times = history.select("t").distinct().withColumnRenamed("t", "now")
    later = F.col("now") >= F.col("t") if own else F.col("now") > F.col("t")
    rows = history.join(times, later)
    return rows.groupBy(F.col("now").alias("t"), "k", "term_id").agg(F.sum(F.col("n") * F.pow(F.lit(float(omega)), F.col("now") - F.col("t"))).alias("n"))


def offsets(sizes: DataFrame, order: list[Column]) -> DataFrame:
    """sizes (shard, docs) with the number of documents of the shards before; a row per shard."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("docs").over(before), F.lit(0)))
