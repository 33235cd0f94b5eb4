"""More operators bound to the test tables: gaps in scores and values, inference with correlation, sparse tables, binning, sinks, streams, and models held against SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning as B
from ..operators import discrimination as G
from ..operators import evidence as E
from ..operators import fit as V
from ..operators import independence as X
from ..operators import lift as L
from ..operators import markov as C
from ..operators import models as M
from ..operators import segments as S
from ..operators import stability as P
from ..operators import transforms as T
from ..operators.once import once
from ..sources import tables as files
from ..sources.tables import table
from ..streaming import arrears, monitor
from .catalog import _EVENT_PSI, ORACLE_SQL, _auc_sql, _late, _lift_sql, _psi_sql, labelled, p_value, query, rounded

# ---- scores with gaps: orders of fewer than three lines have no score, and some have no target

_GAPS = """gaps AS (SELECT o_orderkey AS key, o_orderpriority AS grp, CASE WHEN o_orderkey % 50 <> 3 THEN CAST(o_orderstatus = 'F' AS INTEGER) END AS y, score, score2
  FROM orders LEFT JOIN (SELECT l_orderkey, 0.1::DOUBLE + (sum(d) * 1000 // count(*)) / 12000::DOUBLE AS score, 0.1::DOUBLE + ((sum(d) * 600 + sum(t) * 500) // count(*)) / 12000::DOUBLE AS score2
    FROM (SELECT l_orderkey, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem) GROUP BY 1 HAVING count(*) >= 3) ON l_orderkey = o_orderkey),
sc AS (SELECT * FROM gaps WHERE y IS NOT NULL AND score IS NOT NULL)"""


def gapped(spark: SparkSession, sf: str) -> DataFrame:
    """Orders left-joined to two scores of their lines, which short orders lack."""
    whole = lambda c: F.round(F.col(c) * 100).cast("long")
    sums = table(spark, sf, "lineitem").select("l_orderkey", whole("l_discount").alias("d"), whole("l_tax").alias("t")).groupBy("l_orderkey").agg(F.count("*").alias("__n"), F.sum("d").alias("d"), F.sum("t").alias("t"))
    score = lambda x: F.lit(0.1) + F.expr(f"({x}) div __n") / F.lit(12000.0)
    lines = sums.select("l_orderkey", "__n", score("d * 1000").alias("score"), score("d * 600 + t * 500").alias("score2"))
    y = F.when(F.col("o_orderkey") % 50 != 3, (F.col("o_orderstatus") == "F").cast("int"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("grp"), y.alias("y"))
    return orders.join(lines.where("__n >= 3").select(F.col("l_orderkey").alias("key"), "score", "score2"), "key", "left")


_MISSED = "(SELECT count(*) FROM gaps WHERE y IS NULL OR score IS NULL)"


@query("score_coverage", f"WITH {_GAPS} SELECT grp, count(*) AS n, CAST(count(*) FILTER (WHERE y IS NULL OR score IS NULL) AS BIGINT) AS n_unscored, round(1 - count(*) FILTER (WHERE y IS NULL OR score IS NULL) / count(*), 6) AS scored_share FROM gaps GROUP BY grp")
def _(spark, sf):
    return rounded(G.coverage(gapped(spark, sf), by=["grp"]), "scored_share")


@query("auc_with_gaps", f"WITH {_GAPS}, {_auc_sql()} SELECT round(auc, 6) AS auc, n_pos, n_neg, {_MISSED} AS n_unscored FROM a")
def _(spark, sf):
    return rounded(G.auc(gapped(spark, sf)).select("auc", "n_pos", "n_neg", "n_unscored"), "auc")


_DEVIANCE = """t AS (SELECT -2 * sum(y * ln(score) + (1 - y) * ln(1 - score)) AS d, count(*) AS n, sum(y) AS k FROM sc),
u AS (SELECT *, -2 * (k * ln(k / n) + (n - k) * ln(1 - k / n)) AS d0 FROM t)"""


@query("model_fit_with_gaps", f"WITH {_GAPS}, {_DEVIANCE} SELECT round(d, 4) AS deviance, n, CAST(k AS BIGINT) AS events, round(d0, 4) AS null_deviance, round(1 - d / d0, 6) AS mcfadden_r2, round(d + 6, 4) AS aic, {_MISSED} AS n_unscored FROM u")
def _(spark, sf):
    df = V.fit_summary(V.deviance(gapped(spark, sf)), 3).select("deviance", "n", "events", "null_deviance", "mcfadden_r2", "aic", "n_unscored")
    return rounded(rounded(df, "deviance", "null_deviance", "aic", places=4), "mcfadden_r2")


@query("confusion_with_gaps", f"""
WITH {_GAPS} SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted, CAST(count(y) AS BIGINT) AS n
FROM (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS p) LEFT JOIN sc ON y = a AND CAST(score >= 0.5 AS INTEGER) = p GROUP BY 1, 2""")
def _(spark, sf):
    return G.confusion(gapped(spark, sf))


@query("lift_with_gaps", f"WITH {_GAPS}, {_lift_sql('y')} SELECT decile, count, events, lift, cumulative_lift FROM lift")
def _(spark, sf):
    return rounded(L.lift_table(gapped(spark, sf)).select("decile", "count", "events", "lift", "cumulative_lift"), "lift", "cumulative_lift")


# ---- values with gaps

_HOLES = "SELECT ts, event_type, CASE WHEN ts >= TIMESTAMP '2024-01-16' AND event_id % 2 = 0 OR event_id % 10 = 1 THEN NULL ELSE value END AS value, CAST(event_id % 97 AS DOUBLE) AS rest, CAST(ts >= TIMESTAMP '2024-01-16' AS INTEGER) AS actual FROM events"
_TENTHS = "[" + ", ".join(str(k / 10) for k in range(11)) + "]"


def holed(spark: SparkSession, sf: str) -> DataFrame:
    gone = _late() & (F.col("event_id") % 2 == 0) | (F.col("event_id") % 10 == 1)
    return table(spark, sf, "events").select("ts", F.when(~gone, F.col("value")).alias("value"), (F.col("event_id") % 97).cast("double").alias("rest"))


@query("psi_with_missing", f"WITH h AS ({_HOLES}), {_psi_sql(f'SELECT CASE WHEN value IS NOT NULL THEN CAST(list_sum(list_transform(range(1, 10), lambda k: CASE WHEN value >= e[k + 1] THEN 1 ELSE 0 END)) AS INTEGER) END AS bin, actual FROM h, (SELECT quantile_cont(value, {_TENTHS}) AS e FROM h WHERE actual = 0)')} SELECT bin, round(expected, 6) AS expected, round(actual, 6) AS actual, round(part, 6) AS psi_component FROM c")
def _(spark, sf):
    df = holed(spark, sf)
    binned = T.apply_edges(df, "value", T.equal_frequency_edges(df.where(~_late()), "value", 10), 10)
    return rounded(P.psi_table(P.shares(binned, "bin", _late(), bins=P.grid(df, 10))).select("bin", "expected", "actual", "psi_component"), "expected", "actual", "psi_component")


@query("psi_ranking_with_missing", f"""
WITH h AS ({_HOLES}),
long AS (SELECT 'value' AS variable, value, actual FROM h UNION ALL SELECT 'rest', rest, actual FROM h),
edges AS (SELECT variable, quantile_cont(value, {_TENTHS}) AS e FROM long WHERE actual = 0 GROUP BY 1),
b AS (SELECT variable, actual, CASE WHEN value IS NOT NULL THEN list_sum(list_transform(range(1, 10), lambda k: CASE WHEN value >= e[k + 1] THEN 1 ELSE 0 END)) END AS bin FROM long JOIN edges USING (variable)),
s AS (SELECT variable, bin, greatest(sum(1 - actual) / sum(sum(1 - actual)) OVER (PARTITION BY variable), 0.0001) AS e, greatest(sum(actual) / sum(sum(actual)) OVER (PARTITION BY variable), 0.0001) AS a FROM b GROUP BY 1, 2),
t AS (SELECT variable, sum((a - e) * ln(a / e)) AS psi FROM s GROUP BY 1)
SELECT variable, round(psi, 6) AS psi, {labelled('psi', E.labels.PSI)} AS psi_label FROM t""")
def _(spark, sf):
    return rounded(P.psi_ranking(holed(spark, sf), ["value", "rest"], _late()), "psi")


# ---- inference on Ginis

def _placed_sql(score: str, name: str) -> str:
    """Placement values of every row by comparing all pairs of the two classes; a is the AUC."""
    pairs = f"CASE WHEN p.{score} > n.{score} THEN 1.0 WHEN p.{score} = n.{score} THEN 0.5 ELSE 0 END"
    return f"""
{name}10 AS (SELECT p.key, avg({pairs}) AS v FROM (SELECT * FROM sc WHERE y = 1) p, (SELECT * FROM sc WHERE y = 0) n GROUP BY p.key),
{name}01 AS (SELECT n.key, avg({pairs}) AS v FROM (SELECT * FROM sc WHERE y = 1) p, (SELECT * FROM sc WHERE y = 0) n GROUP BY n.key)"""


_FEW = "sc AS (SELECT o_orderkey AS key, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM orders)"


@query("delong_variance", f"""
WITH {_FEW}, {_placed_sql('score', 'a')},
t AS (SELECT (SELECT avg(v) FROM a10) AS auc, 4 * ((SELECT var_samp(v) / count(*) FROM a10) + (SELECT var_samp(v) / count(*) FROM a01)) AS variance)
SELECT (SELECT count(*) FROM a10) AS n_pos, (SELECT count(*) FROM a01) AS n_neg, 0 AS n_unscored, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, round(variance, 9) AS variance, round(sqrt(variance), 6) AS standard_error,
  round(2 * auc - 1 - 1.959963984540054 * sqrt(variance), 6) AS lower, round(2 * auc - 1 + 1.959963984540054 * sqrt(variance), 6) AS upper FROM t""".replace("0 AS n_unscored", "CAST(0 AS BIGINT) AS n_unscored"))
def _(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (((k * 7919) % 1000).cast("double") / 1000).alias("score"))
    out = rounded(V.delong(df), "auc", "gini", "standard_error", "lower", "upper")
    return rounded(out, "variance", places=9)


@query("delong_by_group", f"""
WITH {_GAPS},
p AS (SELECT p.grp, p.key, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS v FROM sc p JOIN sc n ON p.grp = n.grp AND p.y = 1 AND n.y = 0 GROUP BY 1, 2),
n AS (SELECT n.grp, n.key, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS v FROM sc p JOIN sc n ON p.grp = n.grp AND p.y = 1 AND n.y = 0 GROUP BY 1, 2),
a AS (SELECT grp, count(*) AS n_pos, avg(v) AS auc, var_samp(v) / count(*) AS s FROM p GROUP BY 1), b AS (SELECT grp, count(*) AS n_neg, var_samp(v) / count(*) AS s FROM n GROUP BY 1),
u AS (SELECT grp, count(*) AS n_unscored FROM gaps WHERE y IS NULL OR score IS NULL GROUP BY 1)
SELECT grp, n_pos, n_neg, coalesce(n_unscored, 0) AS n_unscored, round(auc, 6) AS auc, round(4 * (a.s + b.s), 9) AS variance FROM a JOIN b USING (grp) LEFT JOIN u USING (grp)""")
def _(spark, sf):
    out = V.delong(gapped(spark, sf), by=["grp"]).select("grp", "n_pos", "n_neg", "n_unscored", "auc", "variance")
    return rounded(rounded(out, "auc"), "variance", places=9)


@query("delong_compare", f"""
WITH {_GAPS}, {_placed_sql('score', 'a')}, {_placed_sql('score2', 'b')},
t AS (SELECT avg(a.v) AS a1, avg(b.v) AS a2, var_samp(a.v) / count(*) AS v1, var_samp(b.v) / count(*) AS v2, covar_samp(a.v, b.v) / count(*) AS c, count(*) AS n FROM a10 a JOIN b10 b USING (key)),
u AS (SELECT var_samp(a.v) / count(*) AS v1, var_samp(b.v) / count(*) AS v2, covar_samp(a.v, b.v) / count(*) AS c, count(*) AS n FROM a01 a JOIN b01 b USING (key)),
w AS (SELECT t.n AS n_pos, u.n AS n_neg, 2 * a1 - 1 AS gini_1, 2 * a2 - 1 AS gini_2, 4 * (t.v1 + u.v1) AS variance_1, 4 * (t.v2 + u.v2) AS variance_2, 4 * (t.c + u.c) AS covariance FROM t, u),
z AS (SELECT *, gini_2 - gini_1 AS difference, sqrt(variance_1 + variance_2 - 2 * covariance) AS se FROM w),
test AS (SELECT *, {p_value('((difference / se) ** 2)', '1')} AS p FROM z)
SELECT n_pos, n_neg, {_MISSED} AS n_unscored, round(gini_1, 6) AS gini_1, round(gini_2, 6) AS gini_2, round(variance_1, 9) AS variance_1, round(variance_2, 9) AS variance_2, round(covariance, 9) AS covariance, round(covariance / sqrt(variance_1 * variance_2), 5) AS correlation,
  round(difference, 6) AS difference, round(se, 6) AS standard_error, round(difference / se, 5) AS z_statistic, round(p, 5) AS p_value, p < 0.05 AS is_significant, CASE WHEN p >= 0.05 THEN 'no difference' WHEN difference > 0 THEN 'second better' ELSE 'first better' END AS verdict FROM test""")
def _(spark, sf):
    out = V.delong_compare(gapped(spark, sf), "score", "score2").drop("lower", "upper")
    out = rounded(rounded(out, "gini_1", "gini_2", "difference", "standard_error"), "variance_1", "variance_2", "covariance", places=9)
    return rounded(out, "correlation", "z_statistic", "p_value", places=5)


# ---- tests on sparse tables

@query("chi2_sparse", f"""
WITH c AS (SELECT l_partkey AS r, l_suppkey AS s, count(*) AS o FROM lineitem GROUP BY 1, 2),
x AS (SELECT r, sum(o) AS n FROM c GROUP BY 1), y AS (SELECT s, sum(o) AS n FROM c GROUP BY 1),
test AS (SELECT sum(o) * (sum(o * o / (CAST(x.n AS DOUBLE) * y.n)) - 1) AS chi2, ((SELECT count(*) FROM x) - 1) * ((SELECT count(*) FROM y) - 1) AS df FROM c JOIN x USING (r) JOIN y USING (s))
SELECT round(chi2, 4) AS chi2, df FROM test""")
def _(spark, sf):
    return rounded(X.independence(X.counted(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")).select("chi2", "df"), "chi2", places=4)


# ---- binning

_PRICES = """f AS (SELECT o_totalprice AS bin, count(*) FILTER (WHERE o_orderstatus <> 'F') AS goods, count(*) FILTER (WHERE o_orderstatus = 'F') AS bads FROM orders GROUP BY 1)"""


@query("distinct_value_bins", f"WITH {_PRICES} SELECT 'o_totalprice' AS variable, bin, goods, bads FROM f")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return B.distinct_counts(df, ["o_totalprice"], "y")


@query("chi_merge_distinct")
def _(spark, sf):
    """Every distinct price is a bin; rounds depend on a hash, so tests hold them against plain Python."""
    df = table(spark, sf, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return B.chi_merge_rounds(B.distinct_counts(df, ["o_totalprice"], "y"))


_TEN_BINS = f"""
e AS (SELECT quantile_cont(o_totalprice, {_TENTHS}) AS e FROM orders),
o AS (SELECT list_sum(list_transform(range(1, 10), lambda k: CASE WHEN o_totalprice >= e[k + 1] THEN 1 ELSE 0 END)) AS bin, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders, e),
f AS (SELECT CAST(bin AS INTEGER) AS bin, sum(1 - y) AS goods, sum(y) AS bads, row_number() OVER (ORDER BY bin) - 1 AS k FROM o GROUP BY bin),
p AS (SELECT a.k AS i, c.k + 1 AS j, sum(m.goods) / (SELECT sum(goods) FROM f) AS g, sum(m.bads) / (SELECT sum(bads) FROM f) AS b, sum(m.goods + m.bads) / (SELECT sum(goods + bads) FROM f) AS share FROM f a JOIN f c ON a.k <= c.k JOIN f m ON m.k BETWEEN a.k AND c.k GROUP BY 1, 2),
v AS (SELECT i, j, (g - b) * ln(greatest(g, 0.0001) / greatest(b, 0.0001)) AS v, ln(greatest(g, 0.0001) / greatest(b, 0.0001)) AS w FROM p WHERE share >= 0.15)"""


@query("optimal_binning_monotone", f"""
WITH RECURSIVE {_TEN_BINS},
r(parts, j, cuts, total, w, up) AS (SELECT 1, j, [i], v, w, up FROM v, (SELECT unnest([true, false]) AS up) WHERE i = 0
  UNION ALL SELECT parts + 1, v.j, list_append(cuts, v.i), total + v.v, v.w, up FROM r JOIN v ON v.i = r.j AND (up AND v.w >= r.w - 1e-12 OR NOT up AND v.w <= r.w + 1e-12) WHERE parts < 4),
best AS (SELECT cuts FROM r WHERE j = (SELECT count(*) FROM f) ORDER BY round(total, 12) DESC, parts LIMIT 1),
c AS (SELECT bin, list_max(list_filter(cuts, lambda x: x <= k)) AS at FROM f, best)
SELECT c.bin, f.bin AS merged_bin FROM c JOIN f ON f.k = c.at""")
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    stats = E.bin_statistics(T.equal_frequency_bins(df, "o_totalprice", 10), "bin", "y")
    return B.optimal_binning(stats, 4, least_share=0.15, monotone="either")


_SPLIT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("best_splits", f"""
WITH l AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value, l_returnflag AS c FROM lineitem" for c in _SPLIT_COLUMNS)}),
n AS (SELECT variable, value, count(*) FILTER (WHERE c = 'A') AS a, count(*) FILTER (WHERE c = 'N') AS n, count(*) FILTER (WHERE c = 'R') AS r FROM l GROUP BY 1, 2),
u AS (SELECT variable, value, {', '.join(f'CAST(sum({c}) OVER (PARTITION BY variable ORDER BY value) AS DOUBLE) AS l{c}, CAST(sum({c}) OVER (PARTITION BY variable) AS DOUBLE) AS t{c}' for c in 'anr')} FROM n),
x AS (SELECT *, la + ln + lr AS nl, ta + tn + tr AS nt FROM u),
y AS (SELECT variable, value, nl, nt - nl AS nr, 1 - (ta * ta + tn * tn + tr * tr) / (nt * nt) AS impurity, 1 - ((la * la + ln * ln + lr * lr) / nl + ((ta - la) * (ta - la) + (tn - ln) * (tn - ln) + (tr - lr) * (tr - lr)) / (nt - nl)) / nt AS children FROM x WHERE nl < nt),
b AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY round(impurity - children, 12) DESC, value) AS k FROM y)
SELECT variable, value AS threshold, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right, round(impurity, 6) AS impurity, round(impurity - children, 9) AS reduction FROM b WHERE k = 1""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*_SPLIT_COLUMNS, "l_returnflag")
    out = B.best_splits(df, _SPLIT_COLUMNS, "l_returnflag").drop("place")
    return rounded(rounded(out, "impurity"), "reduction", places=9)


@query("sketched_edges", "SELECT CAST(k AS INTEGER) AS decile, count(*) OVER () > 0 AS within_error, n FROM (SELECT unnest(range(0, 11)) AS k), (SELECT count(value) AS n FROM events)")
def _(spark, sf):
    df = table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("value").cast("double").alias("value"))
    whole = B.merged_sketches(B.sketch_quantiles(df, "value", ["day"], 400))
    edges = T.attach(df.where("value IS NOT NULL"), B.sketch_edges(whole, 10)).crossJoin(F.broadcast(whole.select("n")))
    # exact ranks of the edges, of values below and up to them
    ranks = edges.agg(F.max("n").alias("n"), *(F.sum((F.col("value") < F.col("edges")[k]).cast("long")).alias(f"lo{k}") for k in range(11)), *(F.sum((F.col("value") <= F.col("edges")[k]).cast("long")).alias(f"hi{k}") for k in range(11)))
    error = B.rank_error(400)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("decile"), ((F.col(f"lo{k}") / F.col("n") - error <= k / 10) & (F.col(f"hi{k}") / F.col("n") + error >= k / 10)).alias("within_error")) for k in range(11))))
    return ranks.select("n", each.alias("x")).select("x.decile", "x.within_error", "n")


# ---- tables written and read back

@query("partitions_replaced", """
SELECT o_orderstatus, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS revised, round(sum(CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1""")
def _(spark, sf):
    """Orders by status; one partition is replaced by revised rows, the others stay."""
    place = files.scratch_folder(spark)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("revision"), "o_orderstatus")
    files.overwrite_partitions(orders, place, ("o_orderstatus",))
    revised = orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", 2 * F.col("o_totalprice")).withColumn("revision", F.lit(1))
    files.overwrite_partitions(revised, place, ("o_orderstatus",))
    rows = spark.read.parquet(place)
    out = once(rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("revision").cast("long").alias("revised"), F.round(F.sum("o_totalprice"), 2).alias("total")))
    files.drop_folder(spark, place)
    return out


@query("csv_round_trip", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    place = files.scratch_folder(spark)
    files.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment"), place)
    out = once(files.read_csv(spark, place, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string"))
    files.drop_folder(spark, place)
    return out


def bucketed_join(spark: SparkSession, sf: str, names: tuple[str, str], buckets: int = 8) -> DataFrame:
    """Orders and lines saved by order key in the same buckets, and joined; the tables are the caller's to drop."""
    files.write_bucketed(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), names[0], ("o_orderkey",), buckets)
    files.write_bucketed(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), names[1], ("o_orderkey",), buckets)
    return spark.table(names[0]).join(spark.table(names[1]).hint("merge"), "o_orderkey")


@query("bucketed_join", "SELECT o_orderstatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, sf):
    names = tuple(f"bucketed_{uuid.uuid4().hex}" for _ in range(2))
    joined = bucketed_join(spark, sf, names)
    out = once(joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity")))
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    return out


# ---- streams

def _as_stream(spark: SparkSession, rows: DataFrame, place: str, files_: int) -> DataFrame:
    """A table as a stream of files, one a micro-batch. Rows are dealt to files by hash, so each file has rows of all times."""
    rows.repartitionByRange(files_, F.xxhash64("event_id")).write.parquet(place)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(place)


@query("psi_streamed", f"WITH {_EVENT_PSI} SELECT bin, round(expected * 100, 6) AS development_pct, round(actual * 100, 6) AS production_pct, round((actual - expected) * 100, 6) AS difference_pct, round(part, 6) AS psi_component FROM c")
def _(spark, sf):
    """Counts by day of a stream, kept by an idempotent sink, give the stability table of the whole."""
    place = files.scratch_folder(spark)
    events = table(spark, sf, "events").select("event_id", "ts", "value")
    edges = T.equal_frequency_edges(events.where(~_late()), "value", 10).first().edges
    stream = _as_stream(spark, events, f"{place}/in", 3)
    monitor.keep_counts(stream, f"{place}/kept", F.date_format("ts", "yyyy-MM-dd"), "value", edges, f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    dist = monitor.kept_shares(monitor.kept_counts(spark, f"{place}/kept"), F.col("period") >= "2024-01-16", P.grid(events, 10))
    out = once(P.psi_table(dist).drop("expected", "actual"))
    files.drop_folder(spark, place)
    return rounded(out, "development_pct", "production_pct", "difference_pct", "psi_component")


@query("arrears_streamed", ORACLE_SQL["arrears_kpis"])
def _(spark, sf):
    """The batch query's indicators from a stream in which every file has events of all times."""
    place = files.scratch_folder(spark)
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    state = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    stream = arrears.changes(_as_stream(spark, events, f"{place}/in", 3), "user_id", "ts", "event_id", state, "400 days")
    arrears.keep_changes(stream, f"{place}/kept", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    out = once(arrears.kept_kpis(spark, f"{place}/kept").drop("too_late"))
    files.drop_folder(spark, place)
    return rounded(out, "migration_rate", "cure_rate", "default_rate", "mean_steps_in_arrears")


# ---- clusters and models, from their tables of centres and coefficients

_STARTS = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS j, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings WHERE vec_id < 3"


def _lloyd_sql(steps: int) -> str:
    """Lloyd's steps from the first three vectors, unrolled; a<k> assigns to c<k>."""
    out = ["v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)", f"c0 AS ({_STARTS})"]
    for k in range(steps + 1):
        out.append(f"a{k} AS (SELECT vec_id, x, arg_min(j, (list_distance(x, c), j)) AS j, min(list_distance(x, c)) AS d FROM v, c{k} GROUP BY vec_id, x)")
        out.append(f"m{k} AS (SELECT j, i, avg(e) AS e FROM (SELECT j, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY 1, 2)")
        out.append(f"c{k + 1} AS (SELECT j, list(e ORDER BY i) AS c FROM m{k} GROUP BY j)")
    return ",\n".join(out)


@query("kmeans_from_starts", f"WITH {_lloyd_sql(4)} SELECT vec_id, CAST(j AS INTEGER) AS cluster, round(d, 6) AS distance FROM a4")
def _(spark, sf):
    """Four steps from given centres, then every row's cluster and distance to its centre."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    starts = np.array([r.embedding for r in rows.where("vec_id < 3").orderBy("vec_id").collect()], np.float64)
    (centres, _), *_ = S.fit_kmeans(rows, "embedding", [(3, 0)], max_iter=4, tolerance=0.0, starts=[starts])
    out = S.assign(rows, "embedding", centres, squared="d").select("vec_id", "cluster", F.sqrt("d").alias("distance"))
    return rounded(out, "distance")


@query("kmeans_fixed_point", "SELECT CAST(3 AS INTEGER) AS k, true AS nearest, true AS centred, true AS cost_agrees, count(*) AS n FROM embeddings")
def _(spark, sf):
    """A fitted model checked from its table of centres: each row is at its nearest centre, each centre is the mean of its rows, and the cost is the sum of squared distances."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    centres, cost = min(S.fit_kmeans(rows, "x", [(3, 42), (3, 43)]), key=lambda m: m[1])
    held = S.centre_table(rows, centres)
    own = S.assign(rows, "x", centres).join(F.broadcast(held.select(F.collect_list(F.struct("cluster", "centre")).alias("all"))))
    squared = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    own = own.withColumn("ds", F.transform("all", lambda c: F.struct(c["cluster"].alias("j"), squared(c["centre"]).alias("d"))))
    mine = F.element_at(F.filter("ds", lambda e: e["j"] == F.col("cluster")), 1)["d"]
    own = once(own.select("cluster", "x", mine.alias("d"), F.array_min(F.transform("ds", lambda e: e["d"])).alias("least")))
    means = own.select("cluster", F.posexplode("x").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("mean"))
    off = means.join(held.select("cluster", F.posexplode("centre").alias("i", "c")), ["cluster", "i"]).agg((F.max(F.abs(F.col("mean") - F.col("c"))) < 1e-5).alias("centred"))
    out = own.agg(F.count("*").alias("n"), F.max(F.col("d") - F.col("least")).alias("gap"), F.sum("d").alias("sum")).crossJoin(off)
    return out.select(F.lit(3).alias("k"), (F.col("gap") < 1e-9).alias("nearest"), "centred", (F.abs(F.col("sum") - cost) < 1e-6 * cost).alias("cost_agrees"), "n")


def _newton_sql(weighted: bool, penalty: float) -> str:
    """Coefficients of intercept and one scaled number by Newton's steps; the penalty is on the slope."""
    w = "CASE WHEN y = 1 THEN n / (2.0 * k) ELSE n / (2.0 * (n - k)) END" if weighted else "1.0"
    return f"""
o AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(dayofyear(o_orderdate) AS DOUBLE) / 366 + CAST(o_orderkey % 7 AS DOUBLE) * CAST(o_orderstatus = 'F' AS INTEGER) / 20 AS raw FROM orders),
s AS (SELECT *, min(raw) OVER () AS lo, max(raw) OVER () AS hi, count(*) OVER () AS n, sum(y) OVER () AS k FROM o),
d AS (SELECT y, (raw - lo) / (hi - lo) AS x, {w} AS w, n FROM s),
it(t, a, b) AS (SELECT 0, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE) UNION ALL
  SELECT t + 1, a - (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), b - (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01)
  FROM (SELECT t, a, b, sum(w * (p - y)) AS g0, sum(w * (p - y) * x) + {penalty} * b AS g1, sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * x) AS h01, sum(w * p * (1 - p) * x * x) + {penalty} AS h11
    FROM (SELECT it.t, it.a, it.b, d.*, 1 / (1 + exp(-(it.a + it.b * x))) AS p FROM it, d WHERE it.t < 25) GROUP BY t, a, b))"""


def _newton_rows(spark, sf):
    raw = F.dayofyear("o_orderdate").cast("double") / 366 + (F.col("o_orderkey") % 7).cast("double") * (F.col("o_orderstatus") == "F").cast("int") / 20
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query("logistic_by_newton", f"""
WITH RECURSIVE {_newton_sql(False, 1.0)} SELECT '(intercept)' AS feature, round(a, 3) AS coefficient FROM it WHERE t = 25 UNION ALL SELECT 'x', round(b, 3) FROM it WHERE t = 25""")
def _(spark, sf):
    """Unweighted model of one number, L2 of strength 1, against Newton's method."""
    df = _newton_rows(spark, sf)
    return rounded(M.coefficients(M.fit_logistic(df, "y", ["x"], balanced=False), df), "coefficient", places=3)


@query("logistic_balanced_by_newton", f"""
WITH RECURSIVE {_newton_sql(True, 1.0)} SELECT '(intercept)' AS feature, round(a, 3) AS coefficient FROM it WHERE t = 25 UNION ALL SELECT 'x', round(b, 3) FROM it WHERE t = 25""")
def _(spark, sf):
    """The balanced model: both classes weigh alike."""
    df = _newton_rows(spark, sf)
    return rounded(M.coefficients(M.fit_logistic(df, "y", ["x"]), df), "coefficient", places=3)


@query("logistic_predictions", f"""
WITH RECURSIVE {_newton_sql(True, 1.0)}, k AS (SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS DOUBLE) / 366 + CAST(o_orderkey % 7 AS DOUBLE) * CAST(o_orderstatus = 'F' AS INTEGER) / 20 AS raw FROM orders)
SELECT o_orderkey, round(1 / (1 + exp(-(a + b * (raw - lo) / (hi - lo)))), 2) AS score FROM k, it, (SELECT min(raw) AS lo, max(raw) AS hi FROM o) WHERE t = 25""")
def _(spark, sf):
    df = _newton_rows(spark, sf)
    return rounded(M.predict(M.fit_logistic(df, "y", ["x"]), df).select("o_orderkey", "score"), "score", places=2)


# ---- portfolio projection from observed events: bands of users, matrices and start estimated from their steps

_OBSERVED = """
WITH RECURSIVE e AS (SELECT user_id, user_id % 5 + 1 AS band, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS s, lead(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END) OVER w AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT band, s, count(*) AS n, count(*) FILTER (WHERE t = 0) AS n0, count(*) FILTER (WHERE t = 1) AS n1, count(*) FILTER (WHERE t = 2) AS n2 FROM e WHERE s < 2 AND t IS NOT NULL GROUP BY 1, 2),
m AS (SELECT a.band, a.n0 / a.n AS cc, a.n1 / a.n AS ca, a.n2 / a.n AS cd, b.n0 / b.n AS ac, b.n1 / b.n AS aa, b.n2 / b.n AS ad FROM n a JOIN n b ON a.band = b.band AND a.s = 0 AND b.s = 1),
i AS (SELECT band, count(*) FILTER (WHERE s = 0) / count(*) AS c, count(*) FILTER (WHERE s = 1) / count(*) AS a, count(*) FILTER (WHERE s = 2) / count(*) AS d FROM e WHERE r = 1 GROUP BY 1),
k AS (SELECT band, count(*) AS clients FROM e WHERE r = 1 GROUP BY 1),
p AS (SELECT band, 0 AS month, c, a, d FROM i UNION ALL
  SELECT p.band, month + 1, c * cc + a * ac, c * ca + a * aa, c * cd + a * ad + d FROM p JOIN m USING (band) WHERE month < 12),
l AS (SELECT band, 0 AS f, 0 AS t, cc AS p FROM m UNION ALL SELECT band, 0, 1, ca FROM m UNION ALL SELECT band, 0, 2, cd FROM m UNION ALL SELECT band, 1, 0, ac FROM m UNION ALL SELECT band, 1, 1, aa FROM m UNION ALL SELECT band, 1, 2, ad FROM m
  UNION ALL SELECT band, 2, 0, 0 FROM m UNION ALL SELECT band, 2, 1, 0 FROM m UNION ALL SELECT band, 2, 2, 1 FROM m)"""
_BAND = "CAST(band AS INTEGER) AS band"


def _observed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transitions, initial shares and clients by band."""
    state = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    own = (table(spark, sf, "events"), "user_id", F.col("user_id") % 5 + 1, state, ["ts", "event_id"])
    return C.observed_transitions(*own), *C.observed_start(*own)


def _foreseen(spark: SparkSession, sf: str) -> DataFrame:
    return C.project(*_observed(spark, sf)[:2])


@query("observed_transitions", f"{_OBSERVED} SELECT {_BAND}, CAST(f AS INTEGER) AS from_state, CAST(t AS INTEGER) AS to_state, round(p, 8) AS p FROM l")
def _(spark, sf):
    return rounded(_observed(spark, sf)[0], "p", places=8)


@query("observed_start", f"{_OBSERVED} SELECT {_BAND}, CAST(unnest([0, 1, 2]) AS INTEGER) AS state, round(unnest([c, a, d]), 8) AS p FROM i")
def _(spark, sf):
    return rounded(_observed(spark, sf)[1], "p", places=8)


@query("observed_projection", f"{_OBSERVED} SELECT {_BAND}, CAST(month AS INTEGER) AS month, round(c, 8) AS current, round(a, 8) AS arrears, round(d, 8) AS default_share FROM p")
def _(spark, sf):
    return rounded(_foreseen(spark, sf), "current", "arrears", "default_share", places=8)


@query("observed_speed", f"{_OBSERVED}, s AS (SELECT band, round((max(d) FILTER (WHERE month = 12) - max(d) FILTER (WHERE month = 0)) / 12 * 100, 6) AS speed FROM p GROUP BY 1) SELECT {_BAND}, speed FROM s")
def _(spark, sf):
    return rounded(C.deterioration(_foreseen(spark, sf)).select("band", "speed"), "speed")


@query("observed_weighted_matrix", f"{_OBSERVED} SELECT CAST(f AS INTEGER) AS from_state, CAST(t AS INTEGER) AS to_state, round(sum(l.p * clients) / sum(clients), 6) AS p FROM l JOIN k USING (band) GROUP BY f, t")
def _(spark, sf):
    transitions, _, clients = _observed(spark, sf)
    return rounded(C.weighted_matrix(transitions, clients), "p")


@query("observed_time_to_90", f"{_OBSERVED} SELECT {_BAND}, CAST(min(month) FILTER (WHERE d >= 0.9) AS INTEGER) AS months FROM p GROUP BY band")
def _(spark, sf):
    return C.time_to_default(_foreseen(spark, sf))


@query("observed_loss", f"{_OBSERVED} SELECT {_BAND}, CAST(month AS INTEGER) AS month, round(d * clients, 6) AS defaults, round(d * clients * 10000 / 1e6, 6) AS loss_millions FROM p JOIN k USING (band)")
def _(spark, sf):
    return rounded(C.projected_loss(_foreseen(spark, sf), _observed(spark, sf)[2]), "defaults", "loss_millions")


@query("observed_provisions", f"""{_OBSERVED}, x AS (SELECT sum(d * clients) FILTER (WHERE month = 0) AS a, sum(d * clients) FILTER (WHERE month = 12) AS b FROM p JOIN k USING (band))
SELECT round(a, 5) AS initial_defaults, round(b, 5) AS final_defaults, round(b - a, 5) AS increment, round((b - a) / a * 100, 5) AS increment_pct, round((b - a) * 10000, 1) AS additional_provisions FROM x""")
def _(spark, sf):
    df = C.provisions(_foreseen(spark, sf), _observed(spark, sf)[2])
    return rounded(rounded(df, "initial_defaults", "final_defaults", "increment", "increment_pct", places=5), "additional_provisions", places=1)
