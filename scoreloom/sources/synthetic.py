"""Synthetic leads and portfolios of any size. Every number is hashed from the seed, the row's id and the column, so a row is the same however the table is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import normal, uniform
from ..operators.markov import CLIENTS, DEFAULTS
from ..operators.order import attach
from ..operators.transforms import clip, fixed_bins

# Category mixes.
EMPLOYMENT = {"Salaried": 0.50, "Self-employed": 0.30, "Retired": 0.10, "Other": 0.10}
CHANNEL = {"Digital": 0.40, "Branch": 0.30, "Referral": 0.20, "Phone": 0.10}
CHANNEL_PRODUCTION = {"Digital": 0.55, "Branch": 0.20, "Referral": 0.15, "Phone": 0.10}
MARITAL = {"Single": 0.35, "Married": 0.45, "Divorced": 0.15, "Widowed": 0.05}
GENDER = {"M": 0.52, "F": 0.48}
# Additive effects on the conversion probability.
EMPLOYMENT_EFFECT = {"Salaried": 0.004, "Self-employed": -0.002, "Retired": 0.002, "Other": -0.004}
CHANNEL_EFFECT = {"Referral": 0.005, "Branch": 0.003, "Digital": 0.001, "Phone": -0.002}
# Income bins.
INCOME_EDGES = [0, 8000, 15000, 25000, 40000, 50001]
INCOME_LABELS = ["0-8K", "8K-15K", "15K-25K", "25K-40K", "40K+"]
# Mean and deviation of income, in thousands, by band.
INCOME_BY_BAND = {1: (0.5, 0.2), 2: (1.2, 0.3), 3: (2.5, 0.5), 4: (4.5, 0.8), 5: (7.5, 1.5)}


def lognormal(mu: float, sigma: float, z: Column) -> Column:
    return F.exp(F.lit(mu) + F.lit(sigma) * z)


def exponential(scale: Column | float, u: Column) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -F.log(1 - u) * scale


def choice(uniform: Column, shares: dict) -> Column:
    """A value by its share, from a uniform number in a column of its own."""
    out, upto = None, 0.0
    for value, p in shares.items():
        upto += p
        out = F.when(uniform < upto, value) if out is None else out.when(uniform < upto, value)
    return out.otherwise(list(shares)[-1])


def _lookup(key: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, float(v)) if out is None else out.when(key == k, float(v))
    return out.otherwise(0.0)


def conversion_probability(df: DataFrame, out: str = "p") -> DataFrame:
    a = (F.col("age") - 18) / F.lit(52.0)
    p = F.lit(0.005) + (F.col("monthly_income") - 3000) / 47000.0 * 0.015 + F.least(F.col("employment_tenure") / 180.0, F.lit(1.0)) * 0.008
    p = p + 0.006 * (1 - 4 * (a - 0.5) * (a - 0.5)) + _lookup(F.col("employment_type"), EMPLOYMENT_EFFECT) + _lookup(F.col("acquisition_channel"), CHANNEL_EFFECT)
    return df.withColumn(out, clip(p, 0.0, 1.0))


def leads(spark: SparkSession, n: int, seed: int = 42, production: bool = False, noise: float = 0.05) -> DataFrame:
    """Leads and whether they convert; production: lower incomes and tenures, younger, other channels, no income_bin."""
    channel = CHANNEL_PRODUCTION if production else CHANNEL
    u, z = (lambda name, f=f: f(F.lit(seed), F.col("id"), F.lit(name)) for f in (uniform, normal))
    df = spark.range(n).select("id", *(u(f"u{k}").alias(f"u{k}") for k in range(5)), z("e").alias("e"), lognormal(9.8, 0.6, z("i")).alias("i"), exponential(60.0, u("t")).alias("t"), z("g").alias("g"))
    df = df.select(
        "u4", "e",
        clip(F.col("i"), 3000.0, 50000.0).alias("monthly_income"),
        clip(F.col("t"), 0.0, 360.0).cast("int").alias("employment_tenure"),
        clip(38 + 12 * F.col("g"), 18.0, 70.0).cast("int").alias("age"),
        choice(F.col("u0"), EMPLOYMENT).alias("employment_type"),
        choice(F.col("u1"), channel).alias("acquisition_channel"),
        choice(F.col("u2"), MARITAL).alias("marital_status"),
        choice(F.col("u3"), GENDER).alias("gender"),
    )
    if production:
        df = df.withColumns({"monthly_income": F.col("monthly_income") * 0.95, "employment_tenure": F.col("employment_tenure") * F.lit(0.80), "age": F.col("age") - 2})
    df = conversion_probability(df, "p").withColumn("converted", (F.col("u4") < clip(F.col("p") + noise * F.col("e"), 0.0, 1.0)).cast("int")).drop("p", "u4", "e")
    return df if production else fixed_bins(df, "monthly_income", INCOME_EDGES, INCOME_LABELS, "income_bin")


def portfolio(spark: SparkSession, clients: dict = CLIENTS, defaults: dict = DEFAULTS, seed: int = 42) -> DataFrame:
    """Clients by band, exactly the given number of defaults in each: those of greatest probability."""
    n = sum(clients.values())
    band, upto = None, 0
    for b, k in sorted(clients.items()):
        upto += k
        band = F.when(F.col("id") < upto, b) if band is None else band.when(F.col("id") < upto, b)
    u, z = (lambda name, f=f: f(F.lit(seed), F.col("id"), F.lit(name)) for f in (uniform, normal))
    df = spark.range(n).select((F.col("id") + 1).alias("cliente_id"), band.otherwise(max(clients)).alias("banda"), *(z(f"g{k}").alias(f"g{k}") for k in range(4)), *(u(f"u{k}").alias(f"u{k}") for k in range(3)))
    b = F.col("banda").cast("double")
    mean, dev = (_lookup(F.col("banda"), {k: v[j] for k, v in INCOME_BY_BAND.items()}) for j in (0, 1))
    df = df.withColumns({"ingreso_recurrente": F.round(clip((mean + dev * F.col("g0")) * 1000, 100.0, 20000.0), 2), "edad": clip(22 + 5 * b + 5 * F.col("g1"), 18.0, 65.0).cast("int")})
    df = df.withColumns({
        "antiguedad_laboral": F.round(clip(F.greatest(F.lit(0.0), (F.col("edad") - 22) / 10.0 + 0.5 * F.col("g2")), 0.0, 20.0), 2),
        "num_productos": F.when(b <= 2, choice(F.col("u0"), {1: 0.6, 2: 0.3, 3: 0.1})).otherwise(choice(F.col("u0"), {1: 0.3, 2: 0.5, 3: 0.2})),
        "score_comportamiento": clip(350 + 80 * b + 50 * F.col("g3"), 300.0, 850.0).cast("int"),
        "ratio_deuda_ingreso": F.round(clip(exponential(1.5 - 0.2 * b, F.col("u1")), 0.1, 3.0), 2),
        "meses_ultimo_atraso": clip(exponential(b / 0.5, F.col("u2")), 0.0, 60.0).cast("int"),
    })
    c = F.col
    risk = -0.3 * c("ingreso_recurrente") / 1000 - 0.2 * c("score_comportamiento") / 100 + 0.3 * c("ratio_deuda_ingreso") - 0.1 * c("antiguedad_laboral") - 0.1 * c("meses_ultimo_atraso") / 10
    df = df.withColumn("risk", risk)
    stats = df.groupBy("banda").agg(F.avg("risk").alias("mu"), F.stddev_pop("risk").alias("sd"))
    df = attach(df, stats, ["banda"]).withColumn("prob_default", 1 / (1 + F.exp(-(c("risk") - c("mu")) / F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0)))))
    rank = F.row_number().over(Window.partitionBy("banda").orderBy(F.round("prob_default", 9).desc(), "cliente_id"))
    df = df.withColumn("default", (rank <= _lookup(c("banda"), defaults)).cast("int")).withColumn("prob_default", F.round("prob_default", 4))
    return df.select("cliente_id", "banda", "ingreso_recurrente", "edad", "antiguedad_laboral", "num_productos", "score_comportamiento", "ratio_deuda_ingreso", "meses_ultimo_atraso", "default", "prob_default")
