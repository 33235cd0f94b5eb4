"""The operators bound to the test tables, and the same queries in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discrimination as G
from ..operators import evidence as E
from ..operators import fit as V
from ..operators import independence as X
from ..operators import lift as L
from ..operators import markov as C
from ..operators import models as M
from ..operators import relational as R
from ..operators import segments as S
from ..operators import stability as P
from ..operators import transforms as T
from ..sources import synthetic
from ..sources.tables import table
from . import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def p_value(x: str, df: str) -> str:
    return f"(1 - list_sum(list_transform(range(0, CAST(ceil({x}) AS BIGINT) + 250), lambda n: exp(({df} / 2.0 + n) * ln({x} / 2.0) - {x} / 2.0 - lgamma({df} / 2.0 + n + 1)))))"


def labelled(x: str, table: tuple, inclusive: bool = False) -> str:
    sign = "<=" if inclusive else "<"
    return "CASE " + " ".join(f"WHEN {x} {sign} {b} THEN '{n}'" for b, n in table[0]) + f" ELSE '{table[1]}' END"


# ---- transformations

@query("minmax_scale", """
SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS scaled
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def _(spark, sf):
    return rounded(T.min_max_scale(table(spark, sf, "customer"), "c_acctbal", "scaled").select("c_custkey", "scaled"), "scaled")


@query("minmax_given_bounds", """
SELECT c_custkey, round((c_acctbal + 1000) / 11000.0, 6) AS scaled, round(2 * ((c_acctbal - lo) / (hi - lo)) - 1, 6) AS symmetric
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def _(spark, sf):
    df = T.min_max_scale(table(spark, sf, "customer"), "c_acctbal", "scaled", low=-1000, high=10000)
    return rounded(T.min_max_scale(df, "c_acctbal", "symmetric", symmetric=True).select("c_custkey", "scaled", "symmetric"), "scaled", "symmetric")


@query("minmax_by_group", """
SELECT s_suppkey, CASE WHEN hi = lo THEN 0.0 ELSE round((s_acctbal - lo) / nullif(hi - lo, 0), 6) END AS scaled
FROM supplier JOIN (SELECT s_nationkey AS k, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier GROUP BY 1) ON k = s_nationkey""")
def _(spark, sf):
    return rounded(T.min_max_scale(table(spark, sf, "supplier"), "s_acctbal", "scaled", by=["s_nationkey"]).select("s_suppkey", "scaled"), "scaled")


@query("zscore", """
SELECT c_custkey, round((c_acctbal - mu) / sd, 6) AS z
FROM customer, (SELECT avg(c_acctbal) AS mu, stddev_pop(c_acctbal) AS sd FROM customer)""")
def _(spark, sf):
    return rounded(T.z_score(table(spark, sf, "customer"), "c_acctbal", "z").select("c_custkey", "z"), "z")


@query("bins_equal_width", """
SELECT o_orderkey, CAST(list_sum(list_transform(range(1, 10), lambda k: CASE WHEN o_totalprice >= lo + k * ((hi - lo) / 10) THEN 1 ELSE 0 END)) AS INTEGER) AS bin
FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
def _(spark, sf):
    return T.equal_width_bins(table(spark, sf, "orders"), "o_totalprice", 10).select("o_orderkey", "bin")


_FREQUENCY = """
SELECT p_partkey, CAST(list_sum(list_transform(range(1, 5), lambda k: CASE WHEN p_size >= e[k + 1] THEN 1 ELSE 0 END)) AS INTEGER) AS bin
FROM part, (SELECT quantile_cont(CAST(p_size AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM part)"""


@query("bins_equal_freq", _FREQUENCY)
def _(spark, sf):
    return T.equal_frequency_bins(table(spark, sf, "part"), "p_size", 5).select("p_partkey", "bin")


@query("bins_equal_freq_by_rank", _FREQUENCY)
def _(spark, sf):
    return T.equal_frequency_bins(table(spark, sf, "part"), "p_size", 5, method="rank").select("p_partkey", "bin")


_PRICE_EDGES, _PRICE_LABELS = [0, 50000, 100000, 200000, 300000, 400000], ["0-50K", "50K-100K", "100K-200K", "200K-300K", "300K-400K"]
_PRICE_CASE = "CASE WHEN o_totalprice < 0 THEN NULL WHEN o_totalprice <= 50000 THEN '0-50K' WHEN o_totalprice <= 100000 THEN '50K-100K' WHEN o_totalprice <= 200000 THEN '100K-200K' WHEN o_totalprice <= 300000 THEN '200K-300K' WHEN o_totalprice <= 400000 THEN '300K-400K' END"


@query("bins_fixed_labelled", f"SELECT o_orderkey, {_PRICE_CASE} AS label FROM orders")
def _(spark, sf):
    return T.fixed_bins(table(spark, sf, "orders"), "o_totalprice", _PRICE_EDGES, _PRICE_LABELS).select("o_orderkey", "label")


@query("bins_right_closed", """
SELECT p_partkey, CAST(list_sum(list_transform(range(1, 5), lambda k: CASE WHEN p_size > e[k + 1] THEN 1 ELSE 0 END)) AS INTEGER) AS bin
FROM part, (SELECT quantile_cont(CAST(p_size AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM part)""")
def _(spark, sf):
    df = table(spark, sf, "part")
    return T.apply_edges(df, "p_size", T.equal_frequency_edges(df, "p_size", 5), 5, right_closed=True).select("p_partkey", "bin")


@query("bins_frozen_edges", """
SELECT event_id, CAST(list_sum(list_transform(range(1, 10), lambda k: CASE WHEN value >= e[k + 1] THEN 1 ELSE 0 END)) AS INTEGER) AS bin
FROM events, (SELECT quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM events WHERE ts < TIMESTAMP '2024-01-16')
WHERE ts >= TIMESTAMP '2024-01-16'""")
def _(spark, sf):
    df = table(spark, sf, "events")
    old, new = (df.where(f"ts {s} TIMESTAMP_NTZ'2024-01-16 00:00:00'") for s in ("<", ">="))
    return T.apply_edges(new, "value", T.equal_frequency_edges(old, "value", 10), 10).select("event_id", "bin")


@query("label_encode", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer""")
def _(spark, sf):
    return T.label_encode(table(spark, sf, "customer"), "c_mktsegment", "code").select("c_custkey", "code")


@query("clip_round_cast", """
SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS clipped, round_even(c_acctbal / 1000, 0) AS rounded, CAST(trunc(c_acctbal) AS INTEGER) AS whole FROM customer""")
def _(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", T.clip(x, 0.0, 5000.0).alias("clipped"), T.round_half_even(x / 1000).alias("rounded"), T.truncate(x).alias("whole"))


# ---- weight of evidence and information value

_BINNED = """
e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM orders),
b AS (SELECT *, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(list_sum(list_transform(range(1, 10), lambda k: CASE WHEN o_totalprice >= e[k + 1] THEN 1 ELSE 0 END)) AS INTEGER) AS bin FROM orders, e),
s AS (SELECT bin, count(*) AS total, CAST(sum(1 - y) AS BIGINT) AS goods, CAST(sum(y) AS BIGINT) AS bads FROM b GROUP BY bin),
w AS (SELECT *, goods / sum(goods) OVER () AS pg, bads / sum(bads) OVER () AS pb FROM s),
v AS (SELECT *, ln(greatest(pg, 0.0001) / greatest(pb, 0.0001)) AS woe FROM w)"""


def _order_bins(spark, sf, n=10):
    df = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return E.bin_statistics(T.equal_frequency_bins(df, "o_totalprice", n), "bin", "y")


@query("bin_statistics", f"""
WITH {_BINNED}
SELECT bin, total, goods, bads, round(pg, 6) AS pct_goods, round(pb, 6) AS pct_bads, round(goods / total, 6) AS conversion_rate FROM w""")
def _(spark, sf):
    return rounded(_order_bins(spark, sf), "pct_goods", "pct_bads", "conversion_rate")


@query("woe_by_bin", f"""
WITH {_BINNED}
SELECT bin, total, goods, bads, round(woe, 6) AS woe, round((pg - pb) * woe, 6) AS iv_component FROM v""")
def _(spark, sf):
    return rounded(E.with_woe(_order_bins(spark, sf)).select("bin", "total", "goods", "bads", "woe", "iv_component"), "woe", "iv_component")


@query("information_value", f"""
WITH {_BINNED}, t AS (SELECT sum(abs((pg - pb) * woe)) AS iv FROM v)
SELECT round(iv, 6) AS iv, {labelled('iv', E.labels.IV)} AS iv_label FROM t""")
def _(spark, sf):
    return rounded(E.information_value(_order_bins(spark, sf)), "iv")


_CATEGORY = """
s AS (SELECT l_returnflag AS bin, count(*) AS total, CAST(sum(CAST(l_linestatus = 'O' AS INTEGER)) AS BIGINT) AS bads FROM lineitem GROUP BY 1),
w AS (SELECT *, total - bads AS goods, (total - bads) / sum(total - bads) OVER () AS g0, bads / sum(bads) OVER () AS b0 FROM s),
v AS (SELECT *, CASE WHEN g0 = 0 THEN 0.0001 ELSE g0 END AS pg, CASE WHEN b0 = 0 THEN 0.0001 ELSE b0 END AS pb FROM w)"""


@query("woe_categorical", f"""
WITH {_CATEGORY}
SELECT bin, total, bads, goods, round(ln(pg / pb), 6) AS woe, round((pg - pb) * ln(pg / pb), 6) AS iv_component FROM v""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("y", (F.col("l_linestatus") == "O").cast("int"))
    return rounded(E.with_woe(E.bin_statistics(df, "l_returnflag", "y"), "replace").select("bin", "total", "bads", "goods", "woe", "iv_component"), "woe", "iv_component")


_RANKED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def _ranking_sql(columns: list[str], source: str, target: str, fitted: str = "") -> str:
    shares = "[" + ", ".join(str(k / 10) for k in range(11)) + "]"
    return ",\n".join([
        "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value, {target} FROM {source}" for c in columns) + ")",
        "edges AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, quantile_cont(CAST({c} AS DOUBLE), {shares}) AS e FROM {source} {fitted}" for c in columns) + ")",
    ])


@query("iv_ranking", f"""
WITH {_ranking_sql(_RANKED_COLUMNS, 'lineitem', "CAST(l_returnflag = 'R' AS INTEGER) AS y")},
b AS (SELECT variable, y, list_sum(list_transform(range(1, 10), lambda k: CASE WHEN value >= e[k + 1] THEN 1 ELSE 0 END)) AS bin FROM long JOIN edges USING (variable)),
s AS (SELECT variable, bin, sum(1 - y) AS goods, sum(y) AS bads FROM b GROUP BY 1, 2),
w AS (SELECT *, goods / sum(goods) OVER (PARTITION BY variable) AS pg, bads / sum(bads) OVER (PARTITION BY variable) AS pb FROM s),
t AS (SELECT variable, sum(abs((pg - pb) * ln(greatest(pg, 0.0001) / greatest(pb, 0.0001)))) AS iv FROM w GROUP BY 1)
SELECT variable, round(iv, 6) AS iv, {labelled('iv', E.labels.IV)} AS iv_label FROM t""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*_RANKED_COLUMNS, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(E.iv_ranking(df, _RANKED_COLUMNS, "y"), "iv")


@query("rate_by_category", """
SELECT lang, count(*) AS total, CAST(sum(toxic) AS BIGINT) AS converted, round(avg(toxic), 6) AS rate, CAST(count(*) - sum(toxic) AS BIGINT) AS not_converted
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return rounded(E.rate_table(df, "lang", "toxic"), "rate")


@query("rate_by_bin", f"""
SELECT {_PRICE_CASE} AS label, count(*) AS total, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS converted, round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS rate, CAST(sum(CAST(o_orderstatus <> 'F' AS INTEGER)) AS BIGINT) AS not_converted
FROM orders GROUP BY 1""")
def _(spark, sf):
    df = T.fixed_bins(table(spark, sf, "orders"), "o_totalprice", _PRICE_EDGES, _PRICE_LABELS).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(E.rate_table(df, "label", "y"), "rate")


@query("small_bins", f"""
SELECT {_PRICE_CASE} AS label, count(*) AS total, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () < 0.05 AS too_small FROM orders GROUP BY 1""")
def _(spark, sf):
    df = T.fixed_bins(table(spark, sf, "orders"), "o_totalprice", _PRICE_EDGES, _PRICE_LABELS)
    return rounded(T.small_bins(df.groupBy("label").agg(F.count("*").alias("total"))), "share")


_TWENTY = f"""
e AS (SELECT quantile_cont(o_totalprice, [{', '.join(repr(k / 20) for k in range(21))}]) AS e FROM orders),
o AS (SELECT list_sum(list_transform(range(1, 20), lambda k: CASE WHEN o_totalprice >= e[k + 1] THEN 1 ELSE 0 END)) AS bin, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders, e),
f AS (SELECT CAST(bin AS INTEGER) AS bin, CAST(sum(1 - y) AS BIGINT) AS goods, CAST(sum(y) AS BIGINT) AS bads, row_number() OVER (ORDER BY bin) - 1 AS k FROM o GROUP BY bin)"""
_CELL = "(CASE WHEN ({r}) * ({c}) = 0 THEN 0 ELSE (({o}) - CAST({r} AS DOUBLE) * ({c}) / ({n})) ** 2 / (CAST({r} AS DOUBLE) * ({c}) / ({n})) END)"
_PAIR = "list_transform(range(1, len(s)), lambda k: " + " + ".join(_CELL.format(o=f"{side}[{at}]", r=f"(g[{at}] + b[{at}])", c=f"({side}[k] + {side}[k + 1])", n="(g[k] + b[k] + g[k + 1] + b[k + 1])") for at in ("k", "k + 1") for side in ("g", "b")) + ")"


@query("chi_merge", f"""
WITH RECURSIVE {_TWENTY},
m(s, g, b, step) AS (
  SELECT list(bin ORDER BY bin), list(goods ORDER BY bin), list(bads ORDER BY bin), 0 FROM f
  UNION ALL
  SELECT list_slice(s, 1, spot) || list_slice(s, spot + 2, len(s)), list_slice(g, 1, spot - 1) || [g[spot] + g[spot + 1]] || list_slice(g, spot + 2, len(g)), list_slice(b, 1, spot - 1) || [b[spot] + b[spot + 1]] || list_slice(b, spot + 2, len(b)), step + 1
  FROM (SELECT *, list_position(x, list_min(x)) AS spot FROM (SELECT *, {_PAIR} AS x FROM m WHERE len(s) > 1)) WHERE len(s) > 5 OR list_min(x) < 3.841458820694124),
last AS (SELECT s FROM m ORDER BY step DESC LIMIT 1)
SELECT bin, CAST(list_max(list_filter(s, lambda x: x <= bin)) AS INTEGER) AS merged_bin FROM f, last""")
def _(spark, sf):
    return T.chi_merge(_order_bins(spark, sf, 20))


@query("optimal_binning", f"""
WITH RECURSIVE {_TWENTY},
p AS (SELECT a.k AS i, c.k + 1 AS j, sum(m.goods) / (SELECT sum(goods) FROM f) AS g, sum(m.bads) / (SELECT sum(bads) FROM f) AS b FROM f a JOIN f c ON a.k <= c.k JOIN f m ON m.k BETWEEN a.k AND c.k GROUP BY 1, 2),
v AS (SELECT i, j, (g - b) * ln(greatest(g, 0.0001) / greatest(b, 0.0001)) AS v FROM p),
r(parts, j, cuts, total) AS (SELECT 1, j, [i], v FROM v WHERE i = 0 UNION ALL SELECT parts + 1, v.j, list_append(cuts, v.i), total + v.v FROM r JOIN v ON v.i = r.j WHERE parts < 5),
best AS (SELECT cuts FROM r WHERE j = (SELECT count(*) FROM f) ORDER BY round(total, 12) DESC, parts LIMIT 1),
c AS (SELECT bin, list_max(list_filter(cuts, lambda x: x <= k)) AS at FROM f, best)
SELECT c.bin, f.bin AS merged_bin FROM c JOIN f ON f.k = c.at""")
def _(spark, sf):
    return T.optimal_bins(_order_bins(spark, sf, 20))


# ---- stability

_EVENT_EDGES = "SELECT quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM events WHERE ts < TIMESTAMP '2024-01-16'"


def _psi_sql(binned: str) -> str:
    """binned: a SELECT of (bin, actual), with all bins in either period."""
    return f"""
b AS ({binned}),
s AS (SELECT bin, sum(1 - actual) / (SELECT sum(1 - actual) FROM b) AS expected, sum(actual) / (SELECT sum(actual) FROM b) AS actual FROM b GROUP BY bin),
c AS (SELECT *, (greatest(actual, 0.0001) - greatest(expected, 0.0001)) * ln(greatest(actual, 0.0001) / greatest(expected, 0.0001)) AS part FROM s)"""


_EVENT_PSI = _psi_sql(f"SELECT CAST(list_sum(list_transform(range(1, 10), lambda k: CASE WHEN value >= e[k + 1] THEN 1 ELSE 0 END)) AS INTEGER) AS bin, CAST(ts >= TIMESTAMP '2024-01-16' AS INTEGER) AS actual FROM events, ({_EVENT_EDGES})")


def _late() -> Column:
    return F.col("ts") >= F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'")


def _event_shares(spark, sf):
    df = table(spark, sf, "events")
    binned = T.apply_edges(df, "value", T.equal_frequency_edges(df.where(~_late()), "value", 10), 10)
    return P.shares(binned, "bin", _late(), bins=P.grid(df, 10))


@query("psi_numeric", f"WITH {_EVENT_PSI}, t AS (SELECT sum(part) AS psi FROM c) SELECT round(psi, 6) AS psi, {labelled('psi', E.labels.PSI)} AS psi_label FROM t")
def _(spark, sf):
    return rounded(P.psi(_event_shares(spark, sf)), "psi")


@query("psi_table", f"WITH {_EVENT_PSI} SELECT bin, round(expected * 100, 6) AS development_pct, round(actual * 100, 6) AS production_pct, round((actual - expected) * 100, 6) AS difference_pct, round(part, 6) AS psi_component FROM c")
def _(spark, sf):
    return rounded(P.psi_table(_event_shares(spark, sf)).drop("expected", "actual"), "development_pct", "production_pct", "difference_pct", "psi_component")


@query("psi_ranking", f"""
WITH ev AS (SELECT value, hour(ts) AS hour, event_id % 97 AS rest, CAST(ts >= TIMESTAMP '2024-01-16' AS INTEGER) AS actual FROM events),
{_ranking_sql(['value', 'hour', 'rest'], 'ev', 'actual', 'WHERE actual = 0')},
b AS (SELECT variable, actual, list_sum(list_transform(range(1, 10), lambda k: CASE WHEN value >= e[k + 1] THEN 1 ELSE 0 END)) AS bin FROM long JOIN edges USING (variable)),
n AS (SELECT variable, sum(1 - actual) AS ne, sum(actual) AS na FROM b GROUP BY 1),
g AS (SELECT n.*, k.bin FROM n, (SELECT unnest(range(0, 10)) AS bin) k),
q AS (SELECT variable, bin, sum(1 - actual) AS x, sum(actual) AS z FROM b GROUP BY 1, 2),
s AS (SELECT g.variable, greatest(coalesce(x, 0) / ne, 0.0001) AS e, greatest(coalesce(z, 0) / na, 0.0001) AS a FROM g LEFT JOIN q ON q.variable = g.variable AND q.bin = g.bin),
t AS (SELECT variable, sum((a - e) * ln(a / e)) AS psi FROM s GROUP BY 1)
SELECT variable, round(psi, 6) AS psi, {labelled('psi', E.labels.PSI)} AS psi_label FROM t""")
def _(spark, sf):
    df = table(spark, sf, "events").select("ts", "value", F.hour("ts").alias("hour"), (F.col("event_id") % 97).alias("rest"))
    return rounded(P.psi_ranking(df, ["value", "hour", "rest"], _late()), "psi")


@query("psi_categorical", f"WITH {_psi_sql('''SELECT event_type AS bin, CAST(ts >= TIMESTAMP '2024-01-16' AS INTEGER) AS actual FROM events''')}, t AS (SELECT sum(part) AS psi FROM c) SELECT round(psi, 6) AS psi, {labelled('psi', E.labels.PSI)} AS psi_label FROM t")
def _(spark, sf):
    return rounded(P.psi(P.shares(table(spark, sf, "events"), "event_type", _late())), "psi")


@query("psi_fixed_bands", f"WITH {_psi_sql('''SELECT CASE WHEN value < 0 THEN NULL WHEN value <= 20 THEN 'low' WHEN value <= 60 THEN 'mid' WHEN value <= 1000000 THEN 'high' END AS bin, CAST(ts >= TIMESTAMP '2024-01-16' AS INTEGER) AS actual FROM events''')} SELECT bin, round(expected, 6) AS expected, round(actual, 6) AS actual, round(part, 6) AS psi_component FROM c")
def _(spark, sf):
    df = T.fixed_bins(table(spark, sf, "events"), "value", [0, 20, 60, 1e6], ["low", "mid", "high"], "band")
    return rounded(P.psi_table(P.shares(df, "band", _late())).select("bin", "expected", "actual", "psi_component"), "expected", "actual", "psi_component")


# ---- independence

def _cells_sql(relation: str) -> str:
    """relation: a SELECT of (row_key, col_key)."""
    return f"""
r AS ({relation}),
cells AS (SELECT a.row_key, b.col_key, CAST(coalesce(n, 0) AS BIGINT) AS observed FROM (SELECT DISTINCT row_key FROM r) a, (SELECT DISTINCT col_key FROM r) b
  LEFT JOIN (SELECT row_key AS x, col_key AS y, count(*) AS n FROM r GROUP BY 1, 2) ON x = a.row_key AND y = b.col_key),
ex AS (SELECT *, sum(observed) OVER (PARTITION BY row_key) * sum(observed) OVER (PARTITION BY col_key) / sum(observed) OVER () AS expected FROM cells),
st AS (SELECT sum((observed - expected) ** 2 / expected) AS plain, sum((abs(observed - expected) - least(0.5, abs(observed - expected))) ** 2 / expected) AS yates, (count(DISTINCT row_key) - 1) * (count(DISTINCT col_key) - 1) AS df FROM ex),
test AS (SELECT CASE WHEN df = 1 THEN yates ELSE plain END AS chi2, CAST(df AS BIGINT) AS df FROM st)"""


_TESTED = f"SELECT round(chi2, 6) AS chi2, df, round({p_value('chi2', 'df')}, 6) AS p_value, {p_value('chi2', 'df')} < 0.05 AS is_significant FROM test"
_SEGMENTS = "SELECT c_mktsegment AS row_key, n_regionkey AS col_key FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _segments(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, sf, "customer").select("c_mktsegment", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


@query("contingency", f"WITH {_cells_sql(_SEGMENTS)} SELECT * FROM cells")
def _(spark, sf):
    return X.contingency(_segments(spark, sf), "c_mktsegment", "n_regionkey")


@query("chi2_independence", f"WITH {_cells_sql(_SEGMENTS)} {_TESTED}")
def _(spark, sf):
    return rounded(X.independence(X.contingency(_segments(spark, sf), "c_mktsegment", "n_regionkey")), "chi2", "p_value")


@query("chi2_yates", f"WITH {_cells_sql('SELECT quality AS row_key, toxic AS col_key FROM labels')} {_TESTED}")
def _(spark, sf):
    return rounded(X.independence(X.contingency(table(spark, sf, "labels"), "quality", "toxic")), "chi2", "p_value")


@query("chi2_cells", f"WITH {_cells_sql(_SEGMENTS)} SELECT row_key, col_key, observed, round(expected, 6) AS expected, round(observed - expected, 6) AS deviation, CASE WHEN observed > expected THEN 'over' WHEN observed < expected THEN 'under' ELSE 'even' END AS represented FROM ex")
def _(spark, sf):
    return rounded(X.expected_cells(X.contingency(_segments(spark, sf), "c_mktsegment", "n_regionkey")), "expected", "deviation")


@query("chi2_gof", f"""
WITH o AS (SELECT o_orderpriority AS k, count(*) AS observed FROM orders GROUP BY 1),
test AS (SELECT sum((observed - e) ** 2 / e) AS chi2, count(*) - 1 AS df FROM (SELECT *, sum(observed) OVER () / count(*) OVER () AS e FROM o))
{_TESTED}""")
def _(spark, sf):
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(0))
    o = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("observed"))
    return rounded(X.goodness_of_fit(o.withColumn("expected", F.sum("observed").over(every) / F.count("*").over(every))), "chi2", "p_value")


_CHI_COLUMNS = ["o_orderpriority", "month", "half"]


@query("chi2_ranking", " UNION ALL ".join(f"SELECT * FROM (WITH {_cells_sql(f'''SELECT {x} AS row_key, CAST(o_orderstatus = 'F' AS INTEGER) AS col_key FROM orders''')} SELECT '{c}' AS variable, * FROM ({_TESTED}))" for c, x in zip(_CHI_COLUMNS, ["o_orderpriority", "month(o_orderdate)", "CAST(month(o_orderdate) > 6 AS INTEGER)"])))
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderpriority", F.month("o_orderdate").alias("month"), (F.month("o_orderdate") > 6).cast("int").alias("half"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(X.chi2_ranking(df, _CHI_COLUMNS, "y"), "chi2", "p_value")


@query("crosstab", """
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS "F", count(*) FILTER (WHERE l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return X.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


# ---- discrimination

_TIED = "sc AS (SELECT o_orderkey AS key, o_orderpriority AS grp, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM orders)"
_PRICE = "sc AS (SELECT o_orderkey AS key, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice AS score FROM orders)"


def tied(spark: SparkSession, sf: str) -> DataFrame:
    """A scored table with a thousand distinct scores."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("key"), F.col("o_orderpriority").alias("grp"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (((k * 7919) % 1000).cast("double") / 1000).alias("score"))


def priced(spark: SparkSession, sf: str) -> DataFrame:
    """A scored table with hardly any ties."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("score"))


def _auc_sql(by: str = "") -> str:
    part, comma = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""
d AS (SELECT {comma}score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY {comma}score),
u AS (SELECT *, sum(neg) OVER ({part}ORDER BY score) AS upto FROM d),
a AS (SELECT {comma}sum(pos * (upto - neg / 2.0)) / (sum(pos) * sum(neg)) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM u {group})"""


_AUC_COLUMNS = f"round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, n_pos, n_neg, {labelled('2 * auc - 1', E.labels.GINI)} AS gini_label, {labelled('2 * auc - 1', E.labels.GINI_THREE, True)} AS gini_label_short"


@query("auc_gini", f"WITH {_TIED}, {_auc_sql()} SELECT {_AUC_COLUMNS} FROM a")
def _(spark, sf):
    return rounded(G.auc(tied(spark, sf)), "auc", "gini").drop("n_unscored")


@query("auc_gini_by_group", f"WITH {_TIED}, {_auc_sql('grp')} SELECT grp, {_AUC_COLUMNS} FROM a")
def _(spark, sf):
    return rounded(G.auc(tied(spark, sf), by=["grp"]), "auc", "gini").drop("n_unscored")


_ROC = """
d AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY score),
n AS (SELECT *, lead(pos) OVER (ORDER BY score DESC) AS pos1, lead(neg) OVER (ORDER BY score DESC) AS neg1, row_number() OVER (ORDER BY score DESC) AS i,
  sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM d),
roc AS (SELECT score AS threshold, tp / (SELECT sum(pos) FROM d) AS tpr, fp / (SELECT sum(neg) FROM d) AS fpr FROM n WHERE i = 1 OR pos1 IS NULL OR pos <> pos1 OR neg <> neg1)"""


@query("roc_points", f"WITH {_TIED}, {_ROC} SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0")
def _(spark, sf):
    return rounded(G.roc(tied(spark, sf)), "tpr", "fpr")


@query("operating_point", f"""
WITH {_TIED}, {_ROC}, k AS (SELECT u AS wanted, roc.*, row_number() OVER (PARTITION BY u ORDER BY abs(threshold - u), threshold DESC) AS r FROM roc, (SELECT unnest([CAST(0.3 AS DOUBLE), 0.5, 0.7]) AS u))
SELECT wanted, threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(1 - fpr, 6) AS specificity FROM k WHERE r = 1""")
def _(spark, sf):
    return rounded(G.operating_points(G.roc(tied(spark, sf))), "tpr", "fpr", "specificity")


@query("confusion_matrix", f"""
WITH {_TIED} SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted, CAST(count(y) AS BIGINT) AS n
FROM (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS p) LEFT JOIN sc ON y = a AND CAST(score >= 0.5 AS INTEGER) = p GROUP BY 1, 2""")
def _(spark, sf):
    return G.confusion(tied(spark, sf))


def _curve_sql(order: str, points: int) -> str:
    return f"""
r AS (SELECT *, row_number() OVER (ORDER BY score {order}, key) AS i, sum(y) OVER (ORDER BY score {order}, key ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER () AS n, sum(y) OVER () AS p FROM sc)
SELECT CAST(k AS INTEGER) AS point, round(i / n, 6) AS cum_pop, round(cum / p, 6) AS cum_bads FROM r JOIN (SELECT unnest(range(1, {points + 1})) AS k) ON i = (k * n) // {points}
UNION ALL SELECT 0, 0.0, 0.0"""


@query("lorenz_curve", f"WITH {_TIED}, {_curve_sql('ASC', 10)}")
def _(spark, sf):
    return rounded(G.lorenz(tied(spark, sf)), "cum_pop", "cum_bads")


@query("cap_curve", f"WITH {_PRICE}, {_curve_sql('DESC', 20)}")
def _(spark, sf):
    return rounded(G.lorenz(priced(spark, sf), n_points=20, descending=True), "cum_pop", "cum_bads")


@query("lorenz_gini_area", f"""
WITH {_PRICE}, r AS (SELECT y, sum(y) OVER (ORDER BY score, key ROWS UNBOUNDED PRECEDING) AS cum FROM sc)
SELECT round(1 - (2 * sum(cum) - sum(y)) / (count(*) * sum(y)), 6) AS gini_area FROM r""")
def _(spark, sf):
    return rounded(G.lorenz_gini_area(priced(spark, sf)), "gini_area")


@query("concentration", f"""
WITH {_PRICE}, r AS (SELECT y, row_number() OVER (ORDER BY score, key) AS i, count(*) OVER () AS n, sum(y) OVER () AS p FROM sc)
SELECT share, round(sum(CASE WHEN i <= floor(share * n) THEN y ELSE 0 END) / max(p), 6) AS captured FROM r, (SELECT unnest([CAST(0.1 AS DOUBLE), 0.2, 0.3, 0.5]) AS share) GROUP BY share""")
def _(spark, sf):
    return rounded(G.concentration(priced(spark, sf)), "captured")


@query("accuracy_ratio", f"""
WITH {_PRICE}, r AS (SELECT y, sum(y) OVER (ORDER BY score DESC, key ROWS UNBOUNDED PRECEDING) AS cum FROM sc),
t AS (SELECT sum(cum) AS c, sum(y) AS p, CAST(count(*) AS DOUBLE) AS n FROM r)
SELECT round(((2 * c - p) / (2 * n * p) - 0.5) / ((1 - p / n) / 2), 6) AS accuracy_ratio FROM t""")
def _(spark, sf):
    return rounded(G.accuracy_ratio(priced(spark, sf)), "accuracy_ratio")


@query("trapezoid_gini", f"""
WITH {_TIED}, c AS (WITH {_curve_sql('ASC', 10)}),
g AS (SELECT (cum_pop - lag(cum_pop) OVER (ORDER BY point)) * (cum_bads + lag(cum_bads) OVER (ORDER BY point)) AS s FROM c)
SELECT round(1 - sum(s), 4) AS gini FROM g""")
def _(spark, sf):
    return rounded(G.trapezoid_gini(rounded(G.lorenz(tied(spark, sf)), "cum_pop", "cum_bads")), "gini", places=4)


@query("gini_impurity", """
WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS c FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, CAST(sum(c) AS BIGINT) AS n, round(1 - sum(c * c) / (sum(c) * sum(c)), 6) AS impurity FROM c GROUP BY 1""")
def _(spark, sf):
    return rounded(G.impurity(table(spark, sf, "orders"), "o_orderstatus", ["o_orderpriority"]), "impurity")


@query("impurity_split", """
WITH c AS (SELECT o_orderpriority AS k, o_orderstatus AS s, count(*) AS c FROM orders GROUP BY 1, 2),
p AS (SELECT 1 - sum(c * c) / (sum(c) * sum(c)) AS parent FROM (SELECT s, sum(c) AS c FROM c GROUP BY 1)),
q AS (SELECT sum(n * i) / sum(n) AS children FROM (SELECT sum(c) AS n, 1 - sum(c * c) / (sum(c) * sum(c)) AS i FROM c GROUP BY k))
SELECT round(parent, 6) AS parent, round(children, 6) AS children, round(parent - children, 6) AS reduction FROM p, q""")
def _(spark, sf):
    return rounded(G.impurity_reduction(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), "parent", "children", "reduction")


@query("score_histogram", """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
h AS (SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n, any_value(lo) AS lo, any_value((hi - lo) / 50) AS width FROM events, b GROUP BY 1, 2)
SELECT event_type, bin, round(lo + bin * width, 6) AS low, n, round(n / (sum(n) OVER (PARTITION BY event_type) * width), 6) AS density FROM h""")
def _(spark, sf):
    return rounded(G.histogram(table(spark, sf, "events"), "value", 50, ["event_type"]), "low", "density")


# ---- lift

def _lift_sql(y: str) -> str:
    return f"""
r AS (SELECT {y} AS y, row_number() OVER (ORDER BY score DESC, key) - 1 AS i, count(*) OVER () AS n FROM sc),
g AS (SELECT CAST(greatest((i * 10 + n - 2) // (n - 1), 1) AS INTEGER) AS decile, count(*) AS count, CAST(sum(y) AS BIGINT) AS events FROM r GROUP BY 1),
c AS (SELECT *, CAST(sum(events) OVER (ORDER BY decile) AS BIGINT) AS cumulative_events, CAST(sum(count) OVER (ORDER BY decile) AS BIGINT) AS cumulative_count, sum(events) OVER () / sum(count) OVER () AS rate FROM g),
lift AS (SELECT decile, count, events, round(events / count, 6) AS event_rate, cumulative_events, cumulative_count, round(cumulative_events / cumulative_count, 6) AS cumulative_event_rate, round(events / count / rate, 6) AS lift, round(cumulative_events / cumulative_count / rate, 6) AS cumulative_lift FROM c)"""


_LIFT = ("event_rate", "cumulative_event_rate", "lift", "cumulative_lift")


@query("lift_by_decile", f"WITH {_PRICE}, {_lift_sql('y')} SELECT * FROM lift")
def _(spark, sf):
    return rounded(L.lift_table(priced(spark, sf)), *_LIFT)


@query("lift_of_non_events", f"WITH {_TIED}, {_lift_sql('(1 - y)')} SELECT * FROM lift")
def _(spark, sf):
    return rounded(L.lift_table(tied(spark, sf), of_non_events=True), *_LIFT)


@query("lift_summary", f"""
WITH {_PRICE}, {_lift_sql('y')}
SELECT max(lift) FILTER (WHERE decile = 1) AS top_lift, max(cumulative_lift) FILTER (WHERE decile = 3) AS top_cumulative_lift, round(max(cumulative_events) FILTER (WHERE decile = 3) / sum(events) * 100, 6) AS captured_pct FROM lift""")
def _(spark, sf):
    return rounded(L.lift_summary(L.lift_table(priced(spark, sf))), "top_lift", "top_cumulative_lift", "captured_pct")


# ---- fit and inference

_DEVIANCE = """
q AS (SELECT y, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM sc),
d AS (SELECT sum(-2 * (y * ln(p) + (1 - y) * ln(1 - p))) AS deviance, count(*) AS n, CAST(sum(y) AS BIGINT) AS events FROM q),
f AS (SELECT *, -2 * n * (events / n * ln(events / n) + (1 - events / n) * ln(1 - events / n)) AS null_deviance, 2 * n * ln(2.0) AS null_deviance_balanced FROM d)"""
#: A probability near the event rate, so that the fit is not absurd.
_SOFT = "sc AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, 0.2 + 0.25 * (CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000) + CASE WHEN o_orderstatus = 'F' THEN 0.05 ELSE 0 END AS score FROM orders)"


def _soft(spark, sf):
    return tied(spark, sf).select("y", (F.lit(0.2) + F.lit(0.25) * F.col("score") + F.when(F.col("y") == 1, 0.05).otherwise(0.0)).alias("score"))


@query("deviance", f"WITH {_TIED}, {_DEVIANCE} SELECT round(deviance / n, 6) AS deviance, n, events, round(null_deviance / n, 6) AS null_deviance, round(null_deviance_balanced / n, 6) AS null_deviance_balanced FROM f")
def _(spark, sf):
    df = V.deviance(tied(spark, sf)).drop("n_unscored")
    return rounded(df.withColumns({c: F.col(c) / F.col("n") for c in ("deviance", "null_deviance", "null_deviance_balanced")}), "deviance", "null_deviance", "null_deviance_balanced")


@query("model_fit", f"""
WITH {_SOFT}, {_DEVIANCE}, t AS (SELECT *, 1 - deviance / null_deviance AS r2, null_deviance - deviance AS lr FROM f)
SELECT round(r2, 6) AS mcfadden_r2, {labelled('r2', E.labels.R_SQUARED, True)} AS r2_label, round(lr / n, 6) AS deviance_reduction, round((deviance + 6) / n, 6) AS aic, CASE WHEN lr > 1400 THEN 0.0 WHEN lr <= 0 THEN 1.0 ELSE round({p_value('least(greatest(lr, 0.001), 1400.0)', '3')}, 6) END AS lr_p_value FROM t""")
def _(spark, sf):
    df = V.fit_summary(V.deviance(_soft(spark, sf)), 3)
    df = df.select("mcfadden_r2", "r2_label", (F.col("deviance_reduction") / F.col("n")).alias("deviance_reduction"), (F.col("aic") / F.col("n")).alias("aic"), "lr_p_value")
    return rounded(df, "mcfadden_r2", "deviance_reduction", "aic", "lr_p_value")


def _variance_sql(name: str) -> str:
    return f"4 * (auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n_pos * n_neg) AS {name}"


@query("gini_variance_ci", f"""
WITH {_TIED}, {_auc_sql()}, v AS (SELECT *, 2 * auc - 1 AS g, {_variance_sql('variance')} FROM a)
SELECT round(g, 6) AS gini, round(variance, 9) AS variance, round(sqrt(variance), 6) AS standard_error, round(g - 1.959963984540054 * sqrt(variance), 6) AS lower, round(g + 1.959963984540054 * sqrt(variance), 6) AS upper FROM v""")
def _(spark, sf):
    df = V.gini_interval(tied(spark, sf)).select("gini", "variance", "standard_error", "lower", "upper")
    return rounded(rounded(df, "gini", "standard_error", "lower", "upper"), "variance", places=9)


@query("gini_compare", f"""
WITH x AS (WITH {_TIED}, {_auc_sql()} SELECT 2 * auc - 1 AS g1, {_variance_sql('v1')} FROM a), z AS (WITH {_PRICE}, {_auc_sql()} SELECT 2 * auc - 1 AS g2, {_variance_sql('v2')} FROM a),
t AS (SELECT *, g2 - g1 AS d, (g2 - g1) / sqrt(v1 + v2) AS z FROM x, z),
u AS (SELECT *, z * z AS q FROM t)
SELECT round(g1, 6) AS gini_1, round(g2, 6) AS gini_2, round(d, 6) AS difference, round(z, 6) AS z_statistic, round({p_value('q', '1')}, 6) AS p_value, {p_value('q', '1')} < 0.05 AS is_significant,
  CASE WHEN {p_value('q', '1')} >= 0.05 THEN 'no difference' WHEN d > 0 THEN 'second better' ELSE 'first better' END AS verdict FROM u""")
def _(spark, sf):
    df = tied(spark, sf).withColumnRenamed("score", "a").join(priced(spark, sf).select("key", F.col("score").alias("b")), "key")
    return rounded(V.compare_scores(df, "a", "b").drop("variance_1", "variance_2"), "gini_1", "gini_2", "difference", "z_statistic", "p_value")


# ---- segments

@query("calinski_harabasz", """
WITH l AS (SELECT label, unnest(range(1, 65)) AS d, unnest(embedding) AS x FROM embeddings),
c AS (SELECT label, d, count(*) AS m, avg(CAST(x AS DOUBLE)) AS mean, var_pop(CAST(x AS DOUBLE)) AS var FROM l GROUP BY 1, 2),
g AS (SELECT d, sum(m * mean) / sum(m) AS centre, sum(m) AS n FROM c GROUP BY 1),
w AS (SELECT sum(m * var) AS wcss, count(DISTINCT label) AS k FROM c),
b AS (SELECT sum(m * (mean - centre) ** 2) AS bcss, max(n) AS n FROM c JOIN g USING (d))
SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(wcss, 4) AS wcss, round(bcss, 4) AS bcss, round((bcss / (k - 1)) / (wcss / (n - k)), 6) AS calinski_harabasz FROM w, b""")
def _(spark, sf):
    df = S.calinski_harabasz(table(spark, sf, "embeddings"), "embedding", "label").select("n", "k", "wcss", "bcss", "calinski_harabasz")
    return rounded(rounded(df, "calinski_harabasz"), "wcss", "bcss", places=4)


@query("cluster_profile", """
SELECT label, count(*) AS count, round(avg(CAST(embedding[1] AS DOUBLE)), 2) AS mean_a, round(avg(CAST(embedding[2] AS DOUBLE)), 2) AS mean_b, round(avg(CAST(vec_id % 2 AS DOUBLE)), 2) AS rate FROM embeddings GROUP BY label""")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), (F.col("vec_id") % 2).alias("odd"))
    return S.profile(df, "label", ["a", "b"], "odd")


@query("kmeans_sweep")
def _(spark, sf):
    return S.k_sweep(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", range(2, 8), range(42, 52))


@query("kmeans_clusters")
def _(spark, sf):
    return S.kmeans(table(spark, sf, "embeddings"), "embedding", 3, seeds=(42, 43)).select("vec_id", "cluster")


# ---- models

def _training(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"), "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return M.stratified_split(df, "y", "o_orderkey")


@query("stratified_split", """
WITH h AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(('0x' || substr(md5(o_orderkey || ':42'), 1, 15)) AS BIGINT) AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, o_orderkey) AS place, count(*) OVER (PARTITION BY y) AS n FROM h)
SELECT o_orderkey, y, place <= floor(n * CAST(0.3 AS DOUBLE)) AS is_test FROM r""")
def _(spark, sf):
    return _training(spark, sf).select("o_orderkey", "y", "is_test")


@query("scorecard_score", """
SELECT o_orderkey, round(1 / (1 + exp(-(-1.25 + o_totalprice * 0.000004 + dayofyear(o_orderdate) * 0.002))), 6) AS score FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").alias("day"))
    return rounded(M.apply_scorecard(df, -1.25, {"o_totalprice": 0.000004, "day": 0.002}).select("o_orderkey", "score"), "score")


@query("logistic_score")
def _(spark, sf):
    df = _training(spark, sf)
    model = M.fit_logistic(df.where(~F.col("is_test")), "y", ["o_totalprice", "day"], ["o_orderpriority"])
    return M.predict(model, df.where("is_test").drop("is_test"))


@query("logistic_coefficients")
def _(spark, sf):
    df = _training(spark, sf).where(~F.col("is_test"))
    return M.coefficients(M.fit_logistic(df, "y", ["o_totalprice", "day"], ["o_orderpriority"], scaling="zscore"), df)


@query("challenger_comparison")
def _(spark, sf):
    df = _training(spark, sf)
    train, test = df.where(~F.col("is_test")), df.where("is_test").drop("is_test")
    full = M.predict(M.fit_logistic(train, "y", ["o_totalprice", "day"], ["o_orderpriority"]), test, "current")
    return V.compare_scores(M.predict(M.fit_logistic(train, "y", ["o_totalprice"], balanced=False), full, "challenger"), "current", "challenger")


@query("class_weights", """
SELECT o_orderkey, round(n / (2.0 * CASE WHEN y = 1 THEN p ELSE n - p END), 6) AS weight
FROM (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y, count(*) OVER () AS n, sum(CAST(o_orderstatus = 'F' AS INTEGER)) OVER () AS p FROM orders)""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(M.class_weights(df, "y").select("o_orderkey", "weight"), "weight")


# ---- portfolio projection

_VALUES = {
    "m": ", ".join(f"({b}, {', '.join(f'CAST({p!r} AS DOUBLE)' for r in rows[:2] for p in r)})" for b, rows in C.TRANSITIONS.items()),
    "i": ", ".join(f"({b}, {', '.join(f'CAST({p!r} AS DOUBLE)' for p in r)})" for b, r in C.INITIAL.items()),
    "k": ", ".join(f"({b}, {n})" for b, n in C.CLIENTS.items()),
}
_MARKOV = f"""
WITH RECURSIVE m(band, cc, ca, cd, ac, aa, ad) AS (VALUES {_VALUES['m']}),
i(band, c, a, d) AS (VALUES {_VALUES['i']}),
k(band, clients) AS (VALUES {_VALUES['k']}),
p AS (SELECT band, 0 AS month, c, a, d FROM i UNION ALL
  SELECT p.band, month + 1, c * cc + a * ac, c * ca + a * aa, c * cd + a * ad + d FROM p JOIN m USING (band) WHERE month < 12)"""


def _projection(spark):
    return C.project(C.transition_table(spark), C.initial_table(spark))


@query("markov_projection", f"{_MARKOV} SELECT band, CAST(month AS INTEGER) AS month, round(c, 10) AS current, round(a, 10) AS arrears, round(d, 10) AS default_share FROM p")
def _(spark, sf):
    return rounded(_projection(spark), "current", "arrears", "default_share", places=10)


@query("markov_stacked", f"{_MARKOV} SELECT band, CAST(month AS INTEGER) AS month, round(c, 10) AS upto_current, round(c + a, 10) AS upto_arrears, round(c + a + d, 10) AS upto_default FROM p")
def _(spark, sf):
    return rounded(C.stacked(_projection(spark)), "upto_current", "upto_arrears", "upto_default", places=10)


@query("markov_speed", f"{_MARKOV}, s AS (SELECT band, (max(d) FILTER (WHERE month = 12) - max(d) FILTER (WHERE month = 0)) / 12 * 100 AS speed FROM p GROUP BY 1) SELECT band, round(speed, 6) AS speed, row_number() OVER (ORDER BY speed DESC, band) = 1 AS is_fastest FROM s")
def _(spark, sf):
    return rounded(C.deterioration(_projection(spark)), "speed")


@query("weighted_matrix", f"""{_MARKOV}, l AS (
  SELECT band, 0 AS f, 0 AS t, cc AS p FROM m UNION ALL SELECT band, 0, 1, ca FROM m UNION ALL SELECT band, 0, 2, cd FROM m UNION ALL SELECT band, 1, 0, ac FROM m UNION ALL SELECT band, 1, 1, aa FROM m UNION ALL SELECT band, 1, 2, ad FROM m
  UNION ALL SELECT band, 2, 0, 0 FROM m UNION ALL SELECT band, 2, 1, 0 FROM m UNION ALL SELECT band, 2, 2, 1 FROM m)
SELECT CAST(f AS INTEGER) AS from_state, CAST(t AS INTEGER) AS to_state, round(sum(l.p * clients) / sum(clients), 6) AS p FROM l JOIN k USING (band) GROUP BY f, t""")
def _(spark, sf):
    return rounded(C.weighted_matrix(C.transition_table(spark), C.client_table(spark)), "p")


@query("time_to_90", f"{_MARKOV} SELECT band, CAST(min(month) FILTER (WHERE d >= 0.9) AS INTEGER) AS months FROM p GROUP BY band")
def _(spark, sf):
    return C.time_to_default(_projection(spark))


@query("projected_loss", f"{_MARKOV} SELECT band, CAST(month AS INTEGER) AS month, round(d * clients, 6) AS defaults, round(d * clients * 10000 / 1e6, 6) AS loss_millions FROM p JOIN k USING (band)")
def _(spark, sf):
    return rounded(C.projected_loss(_projection(spark), C.client_table(spark)), "defaults", "loss_millions")


@query("provisions", f"""{_MARKOV}, e AS (SELECT sum(d * clients) FILTER (WHERE month = 0) AS a, sum(d * clients) FILTER (WHERE month = 12) AS b FROM p JOIN k USING (band))
SELECT round(a, 6) AS initial_defaults, round(b, 6) AS final_defaults, round(b - a, 6) AS increment, round((b - a) / a * 100, 6) AS increment_pct, round((b - a) * 10000, 2) AS additional_provisions FROM e""")
def _(spark, sf):
    df = C.provisions(_projection(spark), C.client_table(spark))
    return rounded(rounded(df, "initial_defaults", "final_defaults", "increment", "increment_pct"), "additional_provisions", places=2)


@query("initial_state_rule", """
SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 2 WHEN c_nationkey % 5 + 1 <= 2 AND (c_acctbal / 3000 > 1.5 OR c_custkey % 13 < 3) THEN 1
  WHEN c_nationkey % 5 + 1 > 2 AND c_acctbal / 3000 > 2.0 AND c_custkey % 13 < 1 THEN 1 ELSE 0 END AS INTEGER) AS state FROM customer""")
def _(spark, sf):
    c = F.col
    state = C.initial_state((c("c_acctbal") < 0).cast("int"), c("c_nationkey") % 5 + 1, c("c_acctbal") / 3000, c("c_custkey") % 13)
    return table(spark, sf, "customer").select("c_custkey", state.alias("state"))


@query("empirical_transitions", """
WITH s AS (SELECT event_type AS from_state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_state FROM events),
c AS (SELECT from_state, to_state, count(*) AS n FROM s WHERE to_state IS NOT NULL GROUP BY 1, 2)
SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS p FROM c""")
def _(spark, sf):
    return rounded(C.empirical_transitions(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"]), "p")


# ---- general

@query("describe_by_group", " UNION ALL ".join(f"""
SELECT c_mktsegment, '{c}' AS variable, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM customer GROUP BY 1""" for c in ("c_acctbal", "c_nationkey")))
def _(spark, sf):
    return rounded(R.describe(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], ["c_mktsegment"]), "mean", "std", "p25", "p50", "p75", places=4)


@query("null_counts", "SELECT unnest(['c_custkey', 'c_acctbal', 'c_mktsegment']) AS variable, unnest([count(*) - count(c_custkey), count(*) - count(c_acctbal), count(*) - count(c_mktsegment)]) AS nulls FROM customer")
def _(spark, sf):
    return R.null_counts(table(spark, sf, "customer"), ["c_custkey", "c_acctbal", "c_mktsegment"])


@query("value_counts", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1")
def _(spark, sf):
    return R.value_counts(table(spark, sf, "part"), "p_brand")


@query("topk_per_group", """
SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5""")
def _(spark, sf):
    return R.top_k(table(spark, sf, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5).select("c_mktsegment", "c_custkey", "c_acctbal")


@query("inner_join_validation", """
SELECT r_name, count(*) AS nations, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("r_name").agg(F.count("*").alias("nations"), F.sum("n_nationkey").alias("keys"))


@query("union_all", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return R.union_all(a, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("extremes", "SELECT arg_min(p_partkey, (p_retailprice, p_partkey)) AS argmin, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS argmax FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return df.agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("argmin"), F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("argmax"))


# ---- generators

def _u(seed: int, name: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || id || ':{name}'), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def _z(seed: int, name: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_u(seed, name + ':a')})) * cos(2 * 3.141592653589793 * {_u(seed, name + ':b')}))"


def _choice_sql(x: str, shares: dict) -> str:
    upto, out = 0.0, ""
    for value, p in shares.items():
        upto += p
        out += f" WHEN {x} < {upto!r} THEN {value!r}"
    return f"CASE{out} ELSE {list(shares)[-1]!r} END"


def _by_value(x: str, values: dict) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {k!r} THEN {float(v)!r}" for k, v in values.items()) + " ELSE 0.0 END"


def _clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low!r}), {high!r})"


def _leads_sql(n: int, seed: int, production: bool) -> str:
    income, tenure, age = ("monthly_income * 0.95", "employment_tenure * CAST(0.80 AS DOUBLE)", "age - 2") if production else ("monthly_income", "employment_tenure", "age")
    a = "((age - 18) / CAST(52.0 AS DOUBLE))"
    bins = "" if production else ", " + "CASE" + "".join(f" WHEN monthly_income <= {top} THEN '{name}'" for top, name in zip(synthetic.INCOME_EDGES[1:], synthetic.INCOME_LABELS)) + " END AS income_bin"
    return f"""
WITH r AS (SELECT {_u(seed, 'u4')} AS u4, {_z(seed, 'e')} AS e, {_clip(f"exp(9.8 + 0.6 * {_z(seed, 'i')})", 3000.0, 50000.0)} AS monthly_income,
  CAST(trunc({_clip(f"-ln(1 - {_u(seed, 't')}) * 60", 0.0, 360.0)}) AS INTEGER) AS employment_tenure, CAST(trunc({_clip(f"38 + 12 * {_z(seed, 'g')}", 18.0, 70.0)}) AS INTEGER) AS age,
  {_choice_sql(_u(seed, 'u0'), synthetic.EMPLOYMENT)} AS employment_type, {_choice_sql(_u(seed, 'u1'), synthetic.CHANNEL_PRODUCTION if production else synthetic.CHANNEL)} AS acquisition_channel,
  {_choice_sql(_u(seed, 'u2'), synthetic.MARITAL)} AS marital_status, {_choice_sql(_u(seed, 'u3'), synthetic.GENDER)} AS gender FROM range({n}) AS t(id)),
s AS (SELECT * REPLACE ({income} AS monthly_income, {tenure} AS employment_tenure, {age} AS age) FROM r),
p AS (SELECT *, {_clip(f"0.005 + (monthly_income - 3000) / CAST(47000.0 AS DOUBLE) * 0.015 + least(employment_tenure / CAST(180.0 AS DOUBLE), 1.0) * 0.008 + 0.006 * (1 - 4 * ({a} - 0.5) * ({a} - 0.5)) + {_by_value('employment_type', synthetic.EMPLOYMENT_EFFECT)} + {_by_value('acquisition_channel', synthetic.CHANNEL_EFFECT)}", 0.0, 1.0)} AS p FROM s)
SELECT round(monthly_income, 4) AS monthly_income, employment_tenure, age, employment_type, acquisition_channel, marital_status, gender, CAST(u4 < {_clip('p + 0.05 * e', 0.0, 1.0)} AS INTEGER) AS converted{bins} FROM p"""


@query("synthetic_leads", _leads_sql(5000, 42, False))
def _(spark, sf):
    return rounded(synthetic.leads(spark, 5000), "monthly_income", places=4)


@query("synthetic_leads_production", _leads_sql(3000, 123, True))
def _(spark, sf):
    return rounded(synthetic.leads(spark, 3000, seed=123, production=True), "monthly_income", places=4)


def _band_sql() -> str:
    upto, out = 0, ""
    for b, k in sorted(C.CLIENTS.items()):
        upto += k
        out += f" WHEN id < {upto} THEN {b}"
    return f"CASE{out} END"


_FEW, _MORE = {1: 0.6, 2: 0.3, 3: 0.1}, {1: 0.3, 2: 0.5, 3: 0.2}
_MEAN, _DEV = ({k: v[j] for k, v in synthetic.INCOME_BY_BAND.items()} for j in (0, 1))
_PORTFOLIO_SQL = f"""
WITH r AS (SELECT id, {_band_sql()} AS b, {', '.join(f"{_z(42, f'g{k}')} AS g{k}" for k in range(4))}, {', '.join(f"{_u(42, f'u{k}')} AS u{k}" for k in range(3))} FROM range({sum(C.CLIENTS.values())}) AS t(id)),
s AS (SELECT *, round({_clip(f"({_by_value('b', _MEAN)} + {_by_value('b', _DEV)} * g0) * 1000", 100.0, 20000.0)}, 2) AS income, CAST(trunc({_clip('22 + 5 * b + 5 * g1', 18.0, 65.0)}) AS INTEGER) AS age FROM r),
q AS (SELECT *, round({_clip('greatest(0.0, (age - 22) / CAST(10.0 AS DOUBLE) + 0.5 * g2)', 0.0, 20.0)}, 2) AS tenure, CASE WHEN b <= 2 THEN {_choice_sql('u0', _FEW)} ELSE {_choice_sql('u0', _MORE)} END AS products,
  CAST(trunc({_clip('350 + 80 * b + 50 * g3', 300.0, 850.0)}) AS INTEGER) AS score, round({_clip('-ln(1 - u1) * (1.5 - CAST(0.2 AS DOUBLE) * b)', 0.1, 3.0)}, 2) AS debt, CAST(trunc({_clip('-ln(1 - u2) * (b / CAST(0.5 AS DOUBLE))', 0.0, 60.0)}) AS INTEGER) AS late FROM s),
k AS (SELECT *, -CAST(0.3 AS DOUBLE) * income / 1000 - CAST(0.2 AS DOUBLE) * score / 100 + CAST(0.3 AS DOUBLE) * debt - CAST(0.1 AS DOUBLE) * tenure - CAST(0.1 AS DOUBLE) * late / 10 AS risk FROM q),
m AS (SELECT *, 1 / (1 + exp(-(risk - avg(risk) OVER (PARTITION BY b)) / coalesce(nullif(stddev_pop(risk) OVER (PARTITION BY b), 0), 1))) AS p FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(p, 9) DESC, id) <= {_by_value('b', C.DEFAULTS)} AS bad FROM m)
"""


@query("synthetic_portfolio", f"""{_PORTFOLIO_SQL}
SELECT id + 1 AS cliente_id, CAST(b AS INTEGER) AS banda, income AS ingreso_recurrente, age AS edad, tenure AS antiguedad_laboral, CAST(products AS INTEGER) AS num_productos, score AS score_comportamiento, debt AS ratio_deuda_ingreso, late AS meses_ultimo_atraso, CAST(bad AS INTEGER) AS "default", round(p, 4) AS prob_default FROM f""")
def _(spark, sf):
    return synthetic.portfolio(spark)


@query("portfolio_validation", f"""{_PORTFOLIO_SQL},
t(banda, rows, flagged) AS (VALUES {', '.join(f'({b}, {C.CLIENTS[b]}, {C.DEFAULTS[b]})' for b in C.CLIENTS)}),
c AS (SELECT b AS banda, count(*) AS n, CAST(sum(CAST(bad AS INTEGER)) AS BIGINT) AS k FROM f GROUP BY 1)
SELECT CAST(banda AS INTEGER) AS banda, CAST(rows AS BIGINT) AS rows, n, CAST(flagged AS BIGINT) AS flagged, k, CAST(n - rows AS BIGINT) AS rows_off, CAST(k - flagged AS BIGINT) AS flagged_off FROM t JOIN c USING (banda)""")
def _(spark, sf):
    targets = spark.createDataFrame([(b, C.CLIENTS[b], C.DEFAULTS[b]) for b in C.CLIENTS], "banda int, rows long, flagged long")
    return R.validate_counts(synthetic.portfolio(spark), targets, "banda", "default")


@query("intercept_only", """
SELECT o_orderkey, round(avg(CAST(o_orderstatus = 'F' AS DOUBLE)) OVER (), 6) AS score, CAST(0.5 AS DOUBLE) AS balanced_score FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    df = M.intercept_only(M.intercept_only(df, "y", balanced=True, out="balanced_score"), "y")
    return rounded(df.select("o_orderkey", "score", "balanced_score"), "score")


@query("psi_between_tables", """
WITH a AS (SELECT c_nationkey AS bin, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY 1),
b AS (SELECT s_nationkey AS bin, count(*) / sum(count(*)) OVER () AS share FROM supplier GROUP BY 1),
j AS (SELECT greatest(coalesce(a.share, 0), 0.0001) AS e, greatest(coalesce(b.share, 0), 0.0001) AS s FROM a FULL JOIN b ON a.bin = b.bin),
t AS (SELECT sum((s - e) * ln(s / e)) AS psi FROM j)
SELECT round(psi, 6) AS psi, """ + labelled("psi", E.labels.PSI) + """ AS psi_label FROM t""")
def _(spark, sf):
    from pyspark.sql import Window

    def part(name, key):
        counts = table(spark, sf, name).groupBy(F.col(key).alias("bin")).agg(F.count("*").alias("n"))
        return counts.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))

    return rounded(P.psi_between(part("customer", "c_nationkey"), part("supplier", "s_nationkey")), "psi")


@query("hashed_split", "SELECT o_orderkey, CAST(('0x' || substr(md5(o_orderkey || ':42'), 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.3 AS is_test FROM orders")
def _(spark, sf):
    return M.hashed_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("minmax_symmetric_clip", """
SELECT s_suppkey, round(2 * ((s_acctbal - lo) / (hi - lo)) - 1, 6) AS scaled, least(greatest(s_acctbal, -500.0), 9000.0) AS winsorised
FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)""")
def _(spark, sf):
    df = T.min_max_scale(table(spark, sf, "supplier"), "s_acctbal", "scaled", symmetric=True)
    return rounded(df.select("s_suppkey", "scaled", T.clip(F.col("s_acctbal"), -500.0, 9000.0).alias("winsorised")), "scaled")


@query("zscore_by_group", """
SELECT c_custkey, CASE WHEN sd = 0 THEN 0.0 ELSE round((c_acctbal - mu) / sd, 6) END AS z
FROM customer JOIN (SELECT c_mktsegment AS k, avg(c_acctbal) AS mu, stddev_pop(c_acctbal) AS sd FROM customer GROUP BY 1) ON k = c_mktsegment""")
def _(spark, sf):
    return rounded(T.z_score(table(spark, sf, "customer"), "c_acctbal", "z", by=["c_mktsegment"]).select("c_custkey", "z"), "z")


@query("information_value_by_group", """
WITH s AS (SELECT o_orderpriority AS g, month(o_orderdate) AS bin, CAST(sum(CAST(o_orderstatus <> 'F' AS INTEGER)) AS BIGINT) AS goods, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS bads FROM orders GROUP BY 1, 2),
w AS (SELECT g, goods / sum(goods) OVER (PARTITION BY g) AS pg, bads / sum(bads) OVER (PARTITION BY g) AS pb FROM s),
t AS (SELECT g, sum(abs((pg - pb) * ln(greatest(pg, 0.0001) / greatest(pb, 0.0001)))) AS iv FROM w GROUP BY 1)
SELECT g AS o_orderpriority, round(iv, 6) AS iv, """ + labelled("iv", E.labels.IV) + """ AS iv_label FROM t""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderpriority", F.month("o_orderdate").alias("month"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(E.information_value(E.bin_statistics(df, "month", "y", ["o_orderpriority"]), ["o_orderpriority"]), "iv")


# ---- flows and series

@query("flow_features", f"""
WITH {_ranking_sql(_RANKED_COLUMNS, 'lineitem', "CAST(l_returnflag = 'R' AS INTEGER) AS y")},
b AS (SELECT variable, y, CAST(list_sum(list_transform(range(1, 10), lambda k: CASE WHEN value >= e[k + 1] THEN 1 ELSE 0 END)) AS INTEGER) AS bin FROM long JOIN edges USING (variable)),
s AS (SELECT variable, bin, count(*) AS total, CAST(sum(1 - y) AS BIGINT) AS goods, CAST(sum(y) AS BIGINT) AS bads FROM b GROUP BY 1, 2),
w AS (SELECT *, goods / sum(goods) OVER (PARTITION BY variable) AS pg, bads / sum(bads) OVER (PARTITION BY variable) AS pb FROM s),
v AS (SELECT *, ln(greatest(pg, 0.0001) / greatest(pb, 0.0001)) AS woe FROM w),
c AS (SELECT *, (pg - pb) * woe AS part FROM v),
t AS (SELECT *, sum(abs(part)) OVER (PARTITION BY variable) AS iv FROM c)
SELECT variable, bin, total, goods, bads, round(woe, 6) AS woe, round(part, 6) AS iv_component, round(iv, 6) AS iv, {labelled('iv', E.labels.IV)} AS iv_label FROM t""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*_RANKED_COLUMNS, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(flows.evaluate_features(df, _RANKED_COLUMNS, "y", 10), "woe", "iv_component", "iv")


@query("flow_scorecard")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"), "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    found = flows.build_scorecard(df, "o_orderkey", "y", ["o_totalprice", "day"], ["o_orderpriority"])
    return found["gini"].select("gini", "lower", "upper").crossJoin(found["fit"].select("mcfadden_r2", "aic", "lr_p_value")).crossJoin(found["challenger"].select("difference", "p_value"))


@query("flow_provisions", f"""{_MARKOV}, e AS (SELECT sum(d * clients) FILTER (WHERE month = 0) AS a, sum(d * clients) FILTER (WHERE month = 12) AS b FROM p JOIN k USING (band))
SELECT round(a, 6) AS initial_defaults, round(b, 6) AS final_defaults, round((b - a) * 10000, 2) AS additional_provisions FROM e""")
def _(spark, sf):
    df = flows.project_portfolio(spark)["provisions"].select("initial_defaults", "final_defaults", "additional_provisions")
    return rounded(rounded(df, "initial_defaults", "final_defaults"), "additional_provisions", places=2)


@query("state_areas", f"""{_MARKOV}, u AS (SELECT band, month, unnest(['current', 'arrears', 'default']) AS state, unnest([0.0, c, c + a]) AS low, unnest([c, c + a, c + a + d]) AS high FROM p WHERE band IN (1, 3, 5))
SELECT band, CAST(month AS INTEGER) AS month, state, round(low, 8) AS low, round(high, 8) AS high FROM u""")
def _(spark, sf):
    s = C.stacked(_projection(spark).where(F.col("band").isin(1, 3, 5)))
    c, a, d = (F.col(f"upto_{x}") for x in ("current", "arrears", "default"))
    areas = F.explode(F.array(*(F.struct(F.lit(n).alias("state"), low.alias("low"), high.alias("high")) for n, low, high in (("current", F.lit(0.0), c), ("arrears", c, a), ("default", a, d)))))
    return rounded(s.select("band", "month", areas.alias("x")).select("band", "month", "x.*"), "low", "high", places=8)


@query("arrears_kpis", """
WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS s FROM events),
w AS (SELECT s, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, lead(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e)
SELECT round(count(*) FILTER (WHERE s = 0 AND n = 1) / count(*) FILTER (WHERE s = 0 AND n IS NOT NULL), 6) AS migration_rate, round(count(*) FILTER (WHERE s = 1 AND n = 0) / count(*) FILTER (WHERE s = 1 AND n IS NOT NULL), 6) AS cure_rate,
  round(count(*) FILTER (WHERE s < 2 AND n = 2) / count(*) FILTER (WHERE s < 2 AND n IS NOT NULL), 6) AS default_rate, round(count(*) FILTER (WHERE s = 1) / count(*) FILTER (WHERE s = 1 AND coalesce(b, -1) <> 1), 6) AS mean_steps_in_arrears FROM w""")
def _(spark, sf):
    state = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    return rounded(C.arrears_kpis(table(spark, sf, "events"), "user_id", state, ["ts", "event_id"]), "migration_rate", "cure_rate", "default_rate", "mean_steps_in_arrears")


@query("scaling_histograms", """
WITH s AS (SELECT (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS x, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS z FROM customer),
l AS (SELECT 'scaled' AS series, x AS v FROM s UNION ALL SELECT 'standard', z FROM s),
b AS (SELECT series, v, min(v) OVER (PARTITION BY series) AS lo, max(v) OVER (PARTITION BY series) AS hi FROM l)
SELECT series, CAST(least(floor((v - lo) / ((hi - lo) / 20.0) + 1e-9), 19) AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1, 2""")
def _(spark, sf):
    df = T.z_score(T.min_max_scale(table(spark, sf, "customer"), "c_acctbal", "scaled"), "c_acctbal", "standard")
    long = E.unpivot(df, ["scaled", "standard"], []).withColumnRenamed("variable", "series")
    lo_hi = long.groupBy("series").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bin = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20.0) + 1e-9), F.lit(19)).cast("int")
    return T.attach(long, lo_hi, ["series"]).groupBy("series", bin.alias("bin")).agg(F.count("*").alias("n"))


@query("bin_occupancy", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT CAST(list_sum(list_transform(range(1, 5), lambda k: CASE WHEN o_totalprice >= e[k + 1] THEN 1 ELSE 0 END)) AS INTEGER) AS f, CAST(list_sum(list_transform(range(1, 5), lambda k: CASE WHEN o_totalprice >= lo + k * ((hi - lo) / 5) THEN 1 ELSE 0 END)) AS INTEGER) AS w FROM orders, e)
SELECT 'frequency' AS method, f AS bin, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'width', w, count(*) FROM b GROUP BY 2""")
def _(spark, sf):
    df = T.equal_width_bins(T.equal_frequency_bins(table(spark, sf, "orders"), "o_totalprice", 5, "frequency"), "o_totalprice", 5, "width")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("bin")) for m in ("frequency", "width"))))
    return df.select(each.alias("x")).groupBy("x.method", "x.bin").agg(F.count("*").alias("n"))


@query("head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, sf):
    return R.head(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 20, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("formatted_report", "SELECT c_mktsegment, printf('%.2f', avg(c_acctbal)) AS mean, printf('%d', count(*)) AS n FROM customer GROUP BY 1")
def _(spark, sf):
    return R.formatted(table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"), F.count("*").alias("n")), {"mean": "%.2f", "n": "%d"})


from . import extended as extended  # noqa: E402  its queries join these
