"""Mixing sources to target weights by Poisson replication.

A source of weight w and size s, in a mixture of total size B, is to be repeated w * B / s times on
average. Each document's number of copies is drawn from a Poisson distribution of that mean by
inverting its distribution function at a uniform number hashed from the seed and the document's id:
no state, no order, the same draw on every run and retry. A mean above ``MOST_MEAN`` is split into
equal parts below it, each with a draw of its own, whose sum has exactly the distribution wanted. Copies
are exploded and dealt out globally by a hash of id, copy and seed.

All of it is DataFrame functions. The only joined side has a row for each named source and one for
all others, so its size is bound by the parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cut import unused

#: Bits of a hashed number: 52 are exact in a double, 60 fit a long.
_UNIFORM, _ORDER = 13, 15

#: The mixture that the query makes: shares of twenty sources, and of all others together.
SHARES = {"src0": 0.10} | {f"src{i}": 0.03 + 0.002 * i for i in range(1, 20)}
OTHERS = 0.02


#: Greatest mean that is inverted at once: the steps of its distribution are a list of about 800.
MOST_MEAN = 500.0


def hashed(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of the MD5 of the colon-joined parts (null as ''), as a long."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def poisson_steps(mean: Column) -> Column:
    """Distribution function of the Poisson distribution at 0, 1, 2, ... until its tail is below double precision. For means up to MOST_MEAN: lists are built by appending."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    # logarithms of the terms: k ln(mean) - mean - ln(k!), so that no mean underflows
    log_terms = F.aggregate(
        F.sequence(F.lit(1), last),
        F.array(-mean),
        lambda found, k: F.concat(found, F.array(F.element_at(found, -1) + F.log(mean) - F.log(k.cast("double")))),
    )
    return F.aggregate(F.transform(log_terms, F.exp), F.array().cast("array<double>"), lambda found, p: F.concat(found, F.array(p + F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0.0)))))


def mix(docs: DataFrame, weights: dict[str, float], others: float = 0.0, epochs: float = 1.0, seed: int = 0, unit: str = "chars", partitions: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", prefix: str = "") -> DataFrame:
    """``docs`` replicated so that sources make up the given shares, in a global random order.

    weights: relative shares of sources; ``others``: the share of all remaining sources and of null sources together, each document of which has the same rate. epochs: size of the mixture, in sizes of ``docs``, as far as sources have documents. unit: "chars" of text or "docs".

    Added columns (with ``prefix``): copy (1, 2, ...) and order_key; files or partitions are ranges of order_key, and rows in them are sorted by it. Rows of one id, repeated rows among them, have one draw together; rows without id count by their text. A document costs its draws, one for each MOST_MEAN of its mean, and its copies; its text is only measured. A null or empty text has no chars, but is drawn at its source's rate; a source of no size at all (empty texts only, in chars) is left out, as are sources of weight 0. Existing columns of the added names are replaced; any others, whatever their names, stay.
    """
    total = sum(weights.values()) + others
    if not total > 0 or min([*weights.values(), others]) < 0:
        raise ValueError("weights must not be negative, and some must be positive")
    named = {s: i for i, s in enumerate(sorted(weights))}
    group = F.lit(len(named))
    for s, i in named.items():
        group = F.when(F.col(source) == s, i).otherwise(group)
    size = F.coalesce(F.length(text), F.lit(0)).cast("long") if unit == "chars" else F.lit(1).cast("long")
    sizes = docs.select(group.alias("g"), size.alias("n")).groupBy("g").agg(F.sum("n").alias("n"))
    share = F.element_at(F.array(*(F.lit(weights[s] / total) for s in sorted(weights)), F.lit(others / total)), F.col("g") + 1)
    # a row for each group of sources, not for documents
    every = F.sum("n").over(Window.partitionBy(F.lit(0))).cast("double")
    rates = sizes.select("g", (share * F.lit(float(epochs)) * every / F.nullif("n", F.lit(0)).cast("double")).alias("rate")).where("rate > 0")
    base = docs.drop(prefix + "copy", prefix + "order_key")
    g, steps, parts, drawn = unused(base, "__g", "__steps", "__parts", "__drawn")
    split = F.greatest(F.ceil(F.col("rate") / F.lit(MOST_MEAN)), F.lit(1)).cast("int")
    rates = rates.select(F.col("g").alias(g), split.alias(parts), poisson_steps(F.col("rate") / split).alias(steps))
    identity = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")))))

    def draw(*more: Column) -> Column:
        uniform = hashed(_UNIFORM, F.lit(seed), identity, *more) / F.lit(2.0**52)
        return F.size(F.filter(steps, lambda p: p <= uniform))

    copies = F.when(F.col(parts) == 1, draw()).otherwise(F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda n, k: n + draw(F.lit("part"), k)))
    out = base.withColumn(g, group).join(F.broadcast(rates), g).withColumn(drawn, copies).where(F.col(drawn) > 0).drop(g, steps, parts)
    out = out.withColumn(prefix + "copy", F.explode(F.sequence(F.lit(1), F.col(drawn)))).drop(drawn)
    keyed = out.withColumn(prefix + "order_key", hashed(_ORDER, F.lit(seed), identity, F.col(prefix + "copy")))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the keys are uniform, so equal ranges need no sampling pass over the rows
    part = F.floor(F.col(prefix + "order_key") / F.lit(2.0 ** (4 * _ORDER)) * n).cast("int")
    return keyed.repartitionById(n, part).sortWithinPartitions(prefix + "order_key", doc_id)


def poisson_terms(mean: float) -> list[float]:
    """The same steps in plain Python, for tests and SQL."""
    logs = [-mean]
    for k in range(1, math.ceil(mean + 12 * math.sqrt(mean) + 30) + 1):
        logs.append(logs[-1] + math.log(mean) - math.log(k))
    out, run = [], 0.0
    for x in logs:
        run += math.exp(x)
        out.append(run)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARES, OTHERS)


_VALUES = ", ".join(f"('{s}', {w!r})" for s, w in SHARES.items())
ORACLE_SQL = f"""
WITH w(source, weight) AS (VALUES {_VALUES}),
d AS (
  SELECT t.*, coalesce(w.source, '*') AS g, coalesce(w.weight, {OTHERS!r}) AS weight
  FROM documents t LEFT JOIN w ON t.source = w.source),
s AS (SELECT g, max(weight) AS weight, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS n FROM d GROUP BY g),
r AS (
  SELECT g, weight / {sum(SHARES.values()) + OTHERS!r} * (SELECT sum(n) FROM s) / n AS rate FROM s WHERE n > 0),
k AS (
  SELECT g, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS p
  FROM r, (SELECT CAST(unnest(range(0, 400)) AS BIGINT) AS k)
  WHERE k <= rate + 12 * sqrt(rate) + 31),
n AS (
  SELECT d.doc_id, count(*) AS copies FROM d JOIN k USING (g)
  WHERE k.p <= CAST(('0x' || substr(md5('0:' || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0
  GROUP BY d.doc_id),
c AS (SELECT doc_id, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM n)
SELECT t.*, c.copy, CAST(('0x' || substr(md5('0:' || t.doc_id || ':' || c.copy), 1, 15)) AS BIGINT) AS order_key
FROM documents t JOIN c USING (doc_id)
"""
