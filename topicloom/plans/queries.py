"""Registered queries of the topic-model operators, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import operators as ops
from ..functions import natural_key, shard_label
from ..operators.sweep import Config, sweep, traces
from ..sources import coded, entries, numbered, rebase, text_triplets, triplets, vocabulary
from ..sources.store import discard, release, shared_dir, stored
from .fit import one_shard, schedule

K, ALPHA, BETA, SEED, OMEGA = 4, 1.0, 1.0, 7, 0.5
PARTS = ("src1", "src2", "src10")


def _load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- tables of triplets

def _counts(spark, d, table="documents") -> DataFrame:
    if table == "documents":
        return text_triplets(_load(spark, d, "documents"), F.col("source"))
    if table == "events":
        return triplets(_load(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd"), F.col("user_id"), F.col("event_type"))
    if table == "weeks":
        return triplets(_load(spark, d, "events"), F.concat(F.lit("w"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")), F.col("user_id"), F.col("event_type"))
    return triplets(_load(spark, d, "lineitem"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")), F.col("l_suppkey"), F.col("l_partkey"))


class Corpus:
    """The tables that a query needs of one source; those that several of its steps read are written once."""

    def __init__(self, spark: SparkSession, d: str, table: str = "documents"):
        self.spark, self.d, self.table = spark, d, table

    @cached_property
    def counts(self) -> DataFrame:
        return stored(_counts(self.spark, self.d, self.table), "counts")

    @cached_property
    def terms(self) -> DataFrame:
        return stored(vocabulary(self.counts), "terms")

    @cached_property
    def size(self) -> int:
        return self.terms.count()

    @cached_property
    def entries(self) -> DataFrame:
        return entries(self.counts, self.terms)

    @cached_property
    def state(self) -> DataFrame:
        return ops.init_z_uniform(self.entries, K, SEED, "shard", "doc_id", "term_id")

    def written_state(self) -> DataFrame:
        """state, written in steps; each deletes what the one before wrote, so the disk holds two tables and one shuffle."""
        counts, terms = self.counts, self.terms
        release(self.spark)
        ids = stored(coded(counts, terms), "coded")
        self.__dict__.pop("counts")
        discard(counts)
        self.__dict__["entries"] = numbered(ids)
        out = stored(self.state, "state")
        self.__dict__.pop("entries")
        self.__dict__.pop("state")
        discard(ids)
        return out

    def config(self, **more) -> Config:
        return Config(K, self.size, ALPHA, BETA, seed=SEED, **more)


SOURCE = {
    "documents": "SELECT source AS shard, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents",
    "events": "SELECT strftime(ts, '%Y-%m-%d') AS shard, user_id AS doc_id, event_type AS term FROM events",
    "weeks": "SELECT 'w' || ((day(ts) - 1) // 7) AS shard, user_id AS doc_id, event_type AS term FROM events",
    "lineitem": "SELECT 's' || l_linenumber AS shard, l_suppkey AS doc_id, l_partkey::VARCHAR AS term FROM lineitem",
}


def _u(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(',', {', '.join(key)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _base(table="documents") -> str:
    return f"""tok AS ({SOURCE[table]}),
cnt AS (SELECT shard, doc_id, term, count(*) AS n FROM tok GROUP BY ALL),
voc AS (SELECT term, tf, row_number() OVER (ORDER BY tf DESC, term) - 1 AS term_id FROM (SELECT term, sum(n)::BIGINT AS tf FROM cnt GROUP BY term)),
ent AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, term_id) - 1 AS entry_id, doc_id, term_id, n FROM cnt JOIN voc USING (term)),
un AS (SELECT *, {_u("shard", "doc_id", "term_id", "0", str(SEED))} AS u FROM ent),
st0 AS (SELECT * EXCLUDE (u), ((u >= 0.25)::INT + (u >= 0.5)::INT + (u >= 0.75)::INT)::INT AS z FROM un)"""


def _sql(select: str, table="documents") -> str:
    return f"WITH {_base(table)}\n{select}"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


long = lambda c: F.col(c).cast("long").alias(c)


# ---- sources, vocabulary, shards

@query("dtm_counts", _sql("SELECT shard, doc_id, term_id, n FROM ent"))
def dtm_counts(spark, d):
    return Corpus(spark, d).entries.select("shard", "doc_id", long("term_id"), F.col("count").alias("n"))


@query("dtm_vocab", _sql("SELECT term, tf, term_id FROM voc"))
def dtm_vocab(spark, d):
    return vocabulary(_counts(spark, d))


@query("dtm_dims", _sql("SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM voc) AS terms, (SELECT count(*) FROM ent) AS entries, (SELECT sum(n)::BIGINT FROM ent) AS tokens"))
def dtm_dims(spark, d):
    counts = _counts(spark, d)
    docs = _load(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs"))
    return docs.crossJoin(counts.agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("entries"), F.sum("count").alias("tokens")))  # two rows of one


@query("shard_stats", _sql("SELECT shard, min(doc_id) AS least, max(doc_id) AS most, count(*) AS entries, max(doc_id) - min(doc_id) + 1 AS docs FROM ent GROUP BY shard"))
def shard_stats(spark, d):
    return _counts(spark, d).groupBy("shard").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("entries"), (F.max("doc_id") - F.min("doc_id") + 1).alias("docs"))


@query("part_filter", f"SELECT source AS shard, count(*) AS docs FROM documents WHERE source IN {PARTS} GROUP BY source")
def part_filter(spark, d):
    docs = _load(spark, d, "documents")
    return docs.where(F.col("source").isin(*PARTS)).groupBy(F.col("source").alias("shard")).agg(F.count(F.lit(1)).alias("docs"))


@query("shard_label", "SELECT DISTINCT 'data/count_' || source || '.csv' AS file, source AS label, 'label: ' || source || ' iter: 0' AS line FROM documents WHERE source IS NOT NULL")
def shard_labels(spark, d):
    files = _load(spark, d, "documents").where("source is not null").select(F.concat(F.lit("data/count_"), "source", F.lit(".csv")).alias("file")).distinct()
    return files.select("file", shard_label(F.col("file")).alias("label")).withColumn("line", F.format_string("label: %s iter: 0", F.col("label")))


@query("natural_order", "SELECT source AS label, row_number() OVER (ORDER BY regexp_extract(source, '^([^0-9]*)', 1), regexp_extract(source, '([0-9]+)$', 1)::BIGINT) AS place FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def natural_order(spark, d):
    labels = _load(spark, d, "documents").where("source is not null").select(F.col("source").alias("label")).distinct()
    return labels.withColumn("place", F.row_number().over(Window.orderBy(natural_key(F.col("label")), "label")).cast("long"))


@query("doc_rebase", _sql("SELECT shard, entry_id, doc_id - min(doc_id) OVER (PARTITION BY shard) AS doc_id, term_id::INT AS term_id, n::INT AS n FROM ent"))
def doc_rebase(spark, d):
    return rebase(Corpus(spark, d).entries).select("shard", "entry_id", "doc_id", F.col("term_id").cast("int"), F.col("count").cast("int").alias("n"))


# ---- start of z

@query("init_zprob", _sql("SELECT k::INT AS k, term_id, round(p, 9) AS p FROM (SELECT k, term_id, prior / sum(prior) OVER (PARTITION BY term_id) AS p FROM (SELECT k, term_id, (tf * (k + 1) + 1)::DOUBLE AS prior FROM voc, range(4) r(k)))"))
def init_zprob(spark, d):
    terms = Corpus(spark, d).terms
    history = terms.select("term_id", "tf", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("k")).select("k", "term_id", (F.col("tf") * (F.col("k") + 1)).alias("n"))
    p = ops.zprob(ops.zprior(terms, K, BETA, history))
    return p.select("k", "term_id", F.round("p", 9).alias("p"))


@query("init_z", _sql("SELECT shard, entry_id, doc_id, term_id, z FROM st0"))
def init_z(spark, d):
    corpus = Corpus(spark, d)
    p = ops.zprob(ops.zprior(corpus.terms, K, BETA))
    return ops.init_z(corpus.entries, p, SEED, "shard", "doc_id", "term_id").select("shard", "entry_id", "doc_id", "term_id", "z")


# ---- counts

@query("nd_counts", _sql("SELECT shard, doc_id, z AS k, sum(n)::BIGINT AS n FROM st0 GROUP BY ALL"))
def nd_counts(spark, d):
    return ops.nd(Corpus(spark, d).state)


@query("ndsum", _sql("SELECT shard, doc_id, sum(n)::BIGINT AS n FROM st0 GROUP BY ALL"))
def ndsum(spark, d):
    return ops.ndsum(Corpus(spark, d).state)


@query("nw_counts", _sql("SELECT z AS k, term_id, sum(n)::BIGINT AS n FROM st0 GROUP BY ALL"))
def nw_counts(spark, d):
    return ops.nw(Corpus(spark, d).state)


@query("nwsum", _sql("SELECT z AS k, sum(n)::BIGINT AS n FROM st0 GROUP BY ALL"))
def nwsum(spark, d):
    return ops.nwsum(Corpus(spark, d).state)


_ND = "nd AS (SELECT g.shard, g.doc_id, r.k::INT AS k, coalesce(x.n, 0)::BIGINT AS n FROM (SELECT DISTINCT shard, doc_id FROM ent) g CROSS JOIN range(4) r(k) LEFT JOIN (SELECT shard, doc_id, z, sum(n) AS n FROM st0 GROUP BY ALL) x ON x.shard IS NOT DISTINCT FROM g.shard AND x.doc_id = g.doc_id AND x.z = r.k)"
_NW = "nw AS (SELECT r.k::INT AS k, v.term_id, coalesce(x.n, 0)::BIGINT AS n FROM voc v CROSS JOIN range(4) r(k) LEFT JOIN (SELECT z, term_id, sum(n) AS n FROM st0 GROUP BY ALL) x ON x.term_id = v.term_id AND x.z = r.k)"


def _nd_dense(corpus: Corpus) -> DataFrame:
    return ops.dense(ops.nd(corpus.state), corpus.counts.select("shard", "doc_id").distinct(), K)


def _nw_dense(corpus: Corpus) -> DataFrame:
    return ops.dense(ops.nw(corpus.state), corpus.terms.select("term_id"), K)


@query("nd_dense", _sql("").rstrip() + f",\n{_ND} SELECT shard, doc_id, k, n FROM nd")
def nd_dense(spark, d):
    return _nd_dense(Corpus(spark, d)).select("shard", "doc_id", "k", "n")


@query("nw_dense", _sql("").rstrip() + f",\n{_NW} SELECT k, term_id, n FROM nw")
def nw_dense(spark, d):
    return _nw_dense(Corpus(spark, d)).select("k", "term_id", "n")


@query("full_expand", _sql("SELECT shard, doc_id, z AS k, count(*) AS n FROM (SELECT *, unnest(range(n)) AS copy FROM st0) GROUP BY ALL"))
def full_expand(spark, d):
    return ops.tokens(Corpus(spark, d).state).groupBy("shard", "doc_id", F.col("z").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("prior_sums", _sql("SELECT 'alpha' AS kind, doc_id AS id, 4.0::DOUBLE AS total FROM documents UNION ALL SELECT 'beta', r.k, (SELECT count(*) FROM voc)::DOUBLE FROM range(4) r(k)"))
def prior_sums(spark, d):
    return ops.prior_sums(_load(spark, d, "documents"), K, Corpus(spark, d).size, ALPHA, BETA)


@query("post_theta", _sql("").rstrip() + f",\n{_ND} SELECT shard, doc_id, k, round((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY shard, doc_id) + 4.0::DOUBLE), 9) AS theta FROM nd")
def post_theta(spark, d):
    return ops.theta(_nd_dense(Corpus(spark, d)), K, ALPHA).withColumn("theta", F.round("theta", 9))


@query("post_phi", _sql("").rstrip() + f",\n{_NW} SELECT k, term_id, round((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY k) + (SELECT count(*) FROM voc)::DOUBLE), 9) AS phi FROM nw")
def post_phi(spark, d):
    corpus = Corpus(spark, d)
    return ops.phi(_nw_dense(corpus), corpus.size, BETA).withColumn("phi", F.round("phi", 9))


# ---- sweeps; SQL walks each scan with a recursive query

def _sweep_sql(sweeps: int = 1, vector: bool = False, token: bool = False, one: bool = False, fixed: bool = False, table: str = "events", select: str = "") -> str:
    """State of a scan: nw (topics by terms, flat), ns, and nd of the document at hand. Spelled out for four topics."""
    sql = f"WITH RECURSIVE {_base(table)},\nvn AS (SELECT count(*) AS v FROM voc),\n"
    if token:
        sql += f"tk AS (SELECT shard, doc_id, term_id, copy, z, row_number() OVER (PARTITION BY shard ORDER BY entry_id, copy) - 1 AS entry_id FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM st0)),\ne0 AS (SELECT shard, shard || ',' || doc_id AS dk, doc_id, term_id, entry_id, 1::BIGINT AS n, z, copy FROM tk),\n"
    elif one:
        sql += """sz AS (SELECT shard, max(doc_id) + 1 AS docs FROM ent GROUP BY shard),
of AS (SELECT shard, coalesce(sum(docs) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM sz),
e0 AS (SELECT 'all' AS shard, shard || ',' || doc_id AS dk, doc_id + off AS doc_id, term_id, row_number() OVER (ORDER BY shard, entry_id) - 1 AS entry_id, n, z, shard AS origin, doc_id AS d0 FROM st0 JOIN of USING (shard)),
"""
    else:
        sql += "e0 AS (SELECT shard, shard || ',' || doc_id AS dk, doc_id, term_id, entry_id, n, z FROM st0),\n"
    extra = ", copy" if token else ", origin, d0" if one else ""
    for s in range(1, sweeps + 1):
        a, b = f"e{s - 1}", f"e{s}"
        key = ("shard", "doc_id", "term_id", "copy") if token else ("origin", "d0", "term_id") if one else ("shard", "doc_id", "term_id")
        scan = "shard, doc_id" if fixed else "shard"
        sid = "dk" if fixed else "shard"
        sql += f"""nwl{s} AS (SELECT list(n ORDER BY k, term_id) AS nw FROM (SELECT r.k, v.term_id, coalesce(x.n, 0)::BIGINT AS n FROM voc v CROSS JOIN range(4) r(k) LEFT JOIN (SELECT z, term_id, sum(n) AS n FROM {a} GROUP BY ALL) x ON x.term_id = v.term_id AND x.z = r.k)),
nsl{s} AS (SELECT list(n ORDER BY k) AS ns FROM (SELECT r.k, coalesce(sum(n), 0)::BIGINT AS n FROM range(4) r(k) LEFT JOIN {a} ON z = r.k GROUP BY r.k)),
nds{s} AS (SELECT dk, list(n ORDER BY k) AS nd0, sum(n)::BIGINT AS total FROM (SELECT g.dk, r.k, coalesce(x.n, 0)::BIGINT AS n FROM (SELECT DISTINCT dk FROM {a}) g CROSS JOIN range(4) r(k) LEFT JOIN (SELECT dk, z, sum(n) AS n FROM {a} GROUP BY ALL) x ON x.dk = g.dk AND x.z = r.k) GROUP BY dk),
s{s} AS (SELECT {a}.*, {sid} AS sid, row_number() OVER (PARTITION BY {sid} ORDER BY entry_id) AS i, coalesce(lag(dk) OVER (PARTITION BY {sid} ORDER BY entry_id) <> dk, true) AS fresh, nd0, total, {_u(*key, str(s), str(SEED))} AS u FROM {a} JOIN nds{s} USING (dk)),
"""
        if fixed:
            # nothing but nd changes: the counts of the term come with the entry
            sql += f"""w{s} AS (SELECT term_id, list(n ORDER BY k) AS w FROM (SELECT r.k, v.term_id, coalesce(x.n, 0)::BIGINT AS n FROM voc v CROSS JOIN range(4) r(k) LEFT JOIN (SELECT z, term_id, sum(n) AS n FROM {a} GROUP BY ALL) x ON x.term_id = v.term_id AND x.z = r.k) GROUP BY term_id),
t{s} AS MATERIALIZED (SELECT x.*, w, ns FROM s{s} x JOIN w{s} USING (term_id) CROSS JOIN nsl{s}),
"""
            nw_at, ns_at, joined = (lambda k: f"w[{k + 1}]"), (lambda k: f"ns[{k + 1}]"), f"t{s}"
            start, carry, carried = f"SELECT DISTINCT sid, 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS nd, 0 AS znew FROM s{s}", "", ""
            lower = ""
        else:
            nw_at, ns_at, joined = (lambda k: f"nw[{k} * v + term_id + 1]"), (lambda k: f"ns[{k + 1}]"), f"s{s}"
            start = f"SELECT DISTINCT sid, 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS nd, 0 AS znew, nw, ns FROM s{s}, nwl{s}, nsl{s}"
            lower = ", list_transform(p.nw, lambda x, j: x - CASE WHEN j = e.z * v + e.term_id + 1 THEN e.n ELSE 0 END) AS nw, list_transform(p.ns, lambda x, j: x - CASE WHEN j = e.z + 1 THEN e.n ELSE 0 END) AS ns"
            carry = ", list_transform(nw, lambda x, j: x + CASE WHEN j = znew * v + term_id + 1 THEN n ELSE 0 END), list_transform(ns, lambda x, j: x + CASE WHEN j = znew + 1 THEN n ELSE 0 END)"
            carried = ", nw, ns"
        if vector:
            p = lambda k: f"(({nw_at(k)} + 1.0::DOUBLE) / ({ns_at(k)} + v::DOUBLE)) * ((nd[{k + 1}] + 1.0::DOUBLE) / (total - n + 4.0::DOUBLE))"
        else:
            p = lambda k: f"({nw_at(k)} + 1.0::DOUBLE) / ({ns_at(k)} + v::DOUBLE) * (nd[{k + 1}] + 1.0::DOUBLE) / (total - n + 4.0::DOUBLE)"
        wide = ", e.w, e.ns" if fixed else lower
        keep = ", w, ns" if fixed else carried
        sql += f"""r{s} AS (
{start}
UNION ALL
SELECT sid, i, list_transform(nd, lambda x, j: x + CASE WHEN j = znew + 1 THEN n ELSE 0 END), znew{carry} FROM (
SELECT *, (c1 <= u * c4)::INT + (c2 <= u * c4)::INT + (c3 <= u * c4)::INT AS znew FROM (
SELECT *, p4 + c3 AS c4 FROM (SELECT *, p3 + c2 AS c3 FROM (SELECT *, p2 + p1 AS c2, p1 AS c1 FROM (
SELECT sid, i, u, n, term_id, nd, v{keep}, {p(0)} AS p1, {p(1)} AS p2, {p(2)} AS p3, {p(3)} AS p4 FROM (
SELECT e.sid, e.i, e.u, e.n, e.term_id, e.total, v, list_transform(CASE WHEN e.fresh THEN e.nd0 ELSE p.nd END, lambda x, j: x - CASE WHEN j = e.z + 1 THEN e.n ELSE 0 END) AS nd{wide}
FROM r{s} p JOIN {joined} e ON e.sid = p.sid AND e.i = p.i + 1, vn))))))),
{b} AS (SELECT x.shard, x.dk, x.doc_id, x.term_id, x.entry_id, x.n{''.join(f', x.{c.strip()}' for c in extra.split(',') if c.strip())}, x.z AS z_prev, r.znew AS z FROM s{s} x JOIN r{s} r USING (sid, i)),
"""
    return sql.rstrip().rstrip(",") + "\n" + (select or f"SELECT shard, entry_id, doc_id, term_id, z_prev, z FROM e{sweeps}").replace("{e}", f"e{sweeps}")


def _swept(spark, d, table="events", sweeps=1, token=False, fixed=False, vector=False, first=1) -> DataFrame:
    corpus = Corpus(spark, d, table)
    state = corpus.written_state()
    more: dict = {"vector": vector}
    if token:
        state, more["key"] = stored(ops.tokens(state), "tokens"), ("shard", "doc_id", "term_id", "copy")
    cfg = corpus.config(**more)
    for s in range(first, first + sweeps):
        if s > first:
            state = stored(state.drop("z_prev", "trace"), "state")
        state = sweep(state, cfg, s, 1, ops.nw(state) if fixed else None)
    return state


def _assigned(df: DataFrame) -> DataFrame:
    return df.select("shard", "entry_id", "doc_id", "term_id", "z_prev", "z")


QUERIES |= {
    "adlda_pass": lambda s, d: _assigned(_swept(s, d)),
    "adlda_pass_vector_prior": lambda s, d: _assigned(_swept(s, d, vector=True)),
    "adlda_pass_token": lambda s, d: _assigned(_swept(s, d, token=True)),
    "fixed_phi_pass": lambda s, d: _assigned(_swept(s, d, "documents", fixed=True)),
    "fixed_phi_pass_vector_prior": lambda s, d: _assigned(_swept(s, d, fixed=True, vector=True)),
    "fixed_phi_pass_token": lambda s, d: _assigned(_swept(s, d, fixed=True, token=True)),
    "adlda_documents": lambda s, d: _assigned(_swept(s, d, "documents")),
    "events_topics": lambda s, d: ops.nw(_swept(s, d, sweeps=2)),
    "lineitem_topics": lambda s, d: ops.nw(_swept(s, d, "lineitem", fixed=True)),
    "z_trace": lambda s, d: traces(_swept(s, d)).drop("iter"),
    "adlda_merge": lambda s, d: _merged(s, d),
}
ORACLE_SQL |= {
    "adlda_pass": _sweep_sql(),
    "adlda_pass_vector_prior": _sweep_sql(vector=True),
    "adlda_pass_token": _sweep_sql(token=True),
    "fixed_phi_pass": _sweep_sql(fixed=True, table="documents"),
    "fixed_phi_pass_vector_prior": _sweep_sql(fixed=True, vector=True),
    "fixed_phi_pass_token": _sweep_sql(fixed=True, token=True),
    "events_topics": _sweep_sql(2, select="SELECT z AS k, term_id, sum(n)::BIGINT AS n FROM {e} GROUP BY ALL"),
    "lineitem_topics": _sweep_sql(fixed=True, table="lineitem", select="SELECT z AS k, term_id, sum(n)::BIGINT AS n FROM {e} GROUP BY ALL"),
    "z_trace": _sweep_sql(select="SELECT shard, count(*) FILTER (z <> z_prev) AS changed FROM {e} GROUP BY shard"),
    "adlda_merge": _sweep_sql(select="SELECT z AS k, term_id, sum(n)::BIGINT AS n FROM {e} GROUP BY ALL"),
}


def _merged(spark, d) -> DataFrame:
    """The merge from each shard's counts, which are those before with the shard's own changes."""
    swept = stored(_swept(spark, d), "swept")
    before = ops.nw(swept.withColumn("z", F.col("z_prev")))
    own = swept.select("shard", F.col("z").alias("k"), "term_id", F.col("count").alias("n")).union(swept.select("shard", "z_prev", "term_id", -F.col("count")))
    shards = swept.select("shard").distinct()
    parts = own.union(shards.crossJoin(before).select("shard", "k", "term_id", "n")).groupBy("shard", "k", "term_id").agg(F.sum("n").alias("n"))
    return ops.merge(before, parts).where("n <> 0")


@query("gibbs_seq_pass", _sweep_sql(one=True))
def gibbs_seq_pass(spark, d):
    corpus = Corpus(spark, d, "events")
    held = stored(corpus.entries, "entries")
    rows = one_shard(held)
    sizes = ops.offsets(held.groupBy("shard").agg((F.max("doc_id") + 1).alias("docs")), [natural_key(F.col("shard")), F.col("shard")])
    rows = rows.join(F.broadcast(sizes.select(F.col("shard").alias("origin"), "offset")), "origin").withColumn("d0", F.col("doc_id") - F.col("offset")).drop("offset")  # a row per day
    state = ops.init_z_uniform(rows, K, SEED, "origin", "d0", "term_id")
    return _assigned(sweep(stored(state, "state"), corpus.config(key=("origin", "d0", "term_id"))))


@query("merge_models", _sql("SELECT 'all' AS shard, row_number() OVER (ORDER BY regexp_extract(shard, '([0-9]+)$', 1)::BIGINT, entry_id) - 1 AS entry_id, doc_id + off AS doc_id, term_id, n, shard AS origin FROM ent JOIN (SELECT shard, coalesce(sum(docs) OVER (ORDER BY regexp_extract(shard, '([0-9]+)$', 1)::BIGINT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (SELECT shard, max(doc_id) + 1 AS docs FROM ent GROUP BY shard)) USING (shard)"))
def merge_models(spark, d):
    return one_shard(Corpus(spark, d).entries).withColumnRenamed("count", "n")


@query("finagg", _sweep_sql(2, select="SELECT shard, doc_id, k, sum(n)::BIGINT AS n FROM (SELECT shard, doc_id, z AS k, n FROM e1 UNION ALL SELECT shard, doc_id, z, n FROM e2) GROUP BY ALL"))
def finagg(spark, d):
    corpus = Corpus(spark, d, "events")
    cfg = corpus.config()
    first = stored(sweep(stored(corpus.state, "state"), cfg, 1).drop("z_prev", "trace"), "state")
    one, two = ops.nd(first), ops.nd(sweep(first, cfg, 2))
    return one.unionByName(two).groupBy("shard", "doc_id", "k").agg(F.sum("n").alias("n"))


# ---- online: days of events in order of time

def _history(spark, d) -> DataFrame:
    state = stored(Corpus(spark, d, "events").state, "state")
    days = state.select("shard").distinct().withColumn("t", F.row_number().over(Window.orderBy(natural_key(F.col("shard")), "shard")) - 1)
    return state.join(F.broadcast(days), "shard").groupBy("t", F.col("z").alias("k"), "term_id").agg(F.sum("count").alias("n"))  # a row per day


_HIST = "hist AS (SELECT t, z AS k, term_id, sum(n)::BIGINT AS n FROM (SELECT *, (dense_rank() OVER (ORDER BY shard) - 1)::INT AS t FROM st0) GROUP BY ALL)"


def _online_sql(select: str, table: str = "events") -> str:
    return f"WITH {_base(table)},\n{_HIST}\n{select}"


@query("online_zprior", _online_sql("SELECT r.k::INT AS k, v.term_id, coalesce(sum(h.n), 0)::DOUBLE + 1.0::DOUBLE AS prior FROM voc v CROSS JOIN range(4) r(k) LEFT JOIN hist h ON h.term_id = v.term_id AND h.k = r.k GROUP BY ALL"))
def online_zprior(spark, d):
    return ops.zprior(Corpus(spark, d, "events").terms, K, BETA, _history(spark, d)).select("k", "term_id", "prior")


@query("online_prior", _online_sql("SELECT b.t, a.k, a.term_id, round(sum(a.n * pow(0.5::DOUBLE, b.t - a.t)), 6) AS n FROM hist a JOIN (SELECT DISTINCT t FROM hist) b ON b.t > a.t GROUP BY ALL"))
def online_prior(spark, d):
    return ops.decayed(_history(spark, d), OMEGA, own=False).withColumn("n", F.round("n", 6))


@query("online_nw", _online_sql("SELECT b.t, a.k, a.term_id, round(sum(a.n * pow(0.5::DOUBLE, b.t - a.t)), 6) AS n FROM hist a JOIN (SELECT DISTINCT t FROM hist) b ON b.t >= a.t GROUP BY ALL"))
def online_nw(spark, d):
    return ops.decayed(_history(spark, d), OMEGA).withColumn("n", F.round("n", 6))


@query("online_own_nw", _online_sql("SELECT t, k, term_id, n::DOUBLE AS n FROM hist"))
def online_own_nw(spark, d):
    history = _history(spark, d)
    rows = ops.decayed(history, OMEGA).unionByName(ops.decayed(history, OMEGA, own=False).withColumn("n", -F.col("n")))
    return rows.groupBy("t", "k", "term_id").agg(F.round(F.sum("n"), 6).alias("n")).where("n <> 0")


@query("schedule", "SELECT s::INT AS s, (s = 19 OR s % 3 = 0 AND s <> 0) AS merge, (s = 19 OR s % 5 = 0 AND s <> 0) AS write, s >= 16 AS aggregate FROM range(20) r(s)")
def schedules(spark, d):
    return spark.createDataFrame(schedule(20, 3, 5, 4), "s int, merge boolean, write boolean, aggregate boolean")


def _streamed(spark, d, niters: int) -> DataFrame:
    """(t, k, term_id, n) of the online fit over a stream of all weeks."""
    from ..streaming import history_of, start_online

    corpus = Corpus(spark, d, "weeks")
    root = f"{shared_dir(spark)}/online-{uuid.uuid4().hex}"
    rows, terms = corpus.entries, corpus.terms
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    start_online(stream, terms, corpus.config(), f"{root}/out", f"{root}/state", niters=niters, omega=OMEGA).awaitTermination()
    return history_of(spark, f"{root}/out").select(long("t"), F.col("k").cast("int").alias("k"), "term_id", "n")


@query("online_stream", _online_sql("SELECT t::BIGINT AS t, k, term_id, n FROM hist WHERE t = 0", "weeks"))
def online_stream(spark, d):
    """The counts of the first week, before any sweep, out of a stream of all weeks."""
    return _streamed(spark, d, 0).where("t = 0")


@query("online_fit", None)
def online_fit(spark, d):
    """Each week's own counts after two sweeps, out of a stream of all weeks; later weeks start from the decayed ones."""
    return _streamed(spark, d, 2)


@query("top_terms", None)
def top_terms(spark, d, n: int = 10):
    """The n terms of the greatest proportion of each topic, after one distributed sweep over documents."""
    corpus = Corpus(spark, d)
    nw, terms = ops.nw(sweep(corpus.written_state(), corpus.config())), corpus.terms
    best = F.row_number().over(Window.partitionBy("k").orderBy(F.col("phi").desc(), "term_id"))
    phi = ops.phi(nw, corpus.size, BETA).withColumn("place", best).where(F.col("place") <= n)
    return phi.join(terms, "term_id").select("k", "place", "term", F.round("phi", 9).alias("phi"))
