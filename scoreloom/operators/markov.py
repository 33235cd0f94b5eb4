"""Portfolio projection with Markov chains of three states: current, arrears, default."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ("current", "arrears", "default")

# Transition rows from current and from arrears by band; default absorbs.
TRANSITIONS = {
    1: [(0.70, 0.20, 0.10), (0.10, 0.40, 0.50), (0.0, 0.0, 1.0)],
    2: [(0.85, 0.12, 0.03), (0.20, 0.55, 0.25), (0.0, 0.0, 1.0)],
    3: [(0.92, 0.07, 0.01), (0.35, 0.55, 0.10), (0.0, 0.0, 1.0)],
    4: [(0.96, 0.035, 0.005), (0.45, 0.50, 0.05), (0.0, 0.0, 1.0)],
    5: [(0.98, 0.018, 0.002), (0.60, 0.38, 0.02), (0.0, 0.0, 1.0)],
}
# Initial shares of the states by band.
INITIAL = {1: (0.10, 0.10, 0.80), 2: (0.70, 0.13, 0.17), 3: (0.90, 0.05, 0.05), 4: (0.96, 0.02, 0.02), 5: (0.98, 0.01, 0.01)}
# Clients and defaults by band.
CLIENTS = {1: 500, 2: 1200, 3: 2400, 4: 2800, 5: 2300}
DEFAULTS = {1: 400, 2: 200, 3: 120, 4: 60, 5: 20}
LOSS_PER_DEFAULT = 10_000.0


def transition_table(spark: SparkSession, matrices: dict = TRANSITIONS) -> DataFrame:
    """(band, from_state, to_state, p), states as numbers."""
    rows = [(b, i, j, float(p)) for b, m in matrices.items() for i, r in enumerate(m) for j, p in enumerate(r)]
    return spark.createDataFrame(rows, "band int, from_state int, to_state int, p double")


def initial_table(spark: SparkSession, initial: dict = INITIAL) -> DataFrame:
    return spark.createDataFrame([(b, i, float(p)) for b, r in initial.items() for i, p in enumerate(r)], "band int, state int, p double")


def client_table(spark: SparkSession, clients: dict = CLIENTS) -> DataFrame:
    return spark.createDataFrame(list(clients.items()), "band int, clients long")


def project(transitions: DataFrame, initial: DataFrame, months: int = 12) -> DataFrame:
    """(band, month, current, arrears, default_share) for months 0 to ``months``: bands are rows, months a fold over an array."""
    m = transitions.groupBy("band").agg(F.transform(F.sort_array(F.collect_list(F.struct("from_state", "to_state", "p"))), lambda x: x["p"]).alias("m"))
    s = initial.groupBy("band").agg(F.transform(F.sort_array(F.collect_list(F.struct("state", "p"))), lambda x: x["p"]).alias("s"))

    def step(path: Column, _: Column) -> Column:
        last = F.element_at(path, -1)
        new = F.array(*(sum((last[i] * F.col("m")[3 * i + j] for i in range(1, 3)), last[0] * F.col("m")[j]) for j in range(3)))
        return F.concat(path, F.array(new))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(months)), F.array("s"), step) if months else F.array("s")
    out = m.join(s, "band").select("band", F.posexplode(path).alias("month", "x"))
    return out.select("band", "month", F.col("x")[0].alias("current"), F.col("x")[1].alias("arrears"), F.col("x")[2].alias("default_share"))


def deterioration(projection: DataFrame) -> DataFrame:
    """band, speed (percentage points of default a month), is_fastest (the first of the greatest)."""
    last = projection.groupBy("band").agg(F.max("month").alias("__m"), F.max_by("default_share", "month").alias("__b"), F.min_by("default_share", "month").alias("__a"))
    out = last.select("band", ((F.col("__b") - F.col("__a")) / F.nullif("__m", F.lit(0)).cast("double") * 100).alias("speed"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("speed"), "band")
    return out.withColumn("is_fastest", F.row_number().over(w) == 1)


def weighted_matrix(transitions: DataFrame, clients: DataFrame) -> DataFrame:
    """(from_state, to_state, p) of the whole portfolio, bands weighted by clients."""
    rows = transitions.join(F.broadcast(clients), "band")
    return rows.groupBy("from_state", "to_state").agg((F.sum(F.col("p") * F.col("clients")) / F.sum("clients")).alias("p"))


def time_to_default(projection: DataFrame, level: float = 0.9) -> DataFrame:
    """band, months: the first month with at least that share in default, or null."""
    return projection.groupBy("band").agg(F.min(F.when(F.col("default_share") >= level, F.col("month"))).alias("months"))


def projected_loss(projection: DataFrame, clients: DataFrame, loss: float = LOSS_PER_DEFAULT) -> DataFrame:
    """(band, month, defaults, loss_millions)."""
    out = projection.join(F.broadcast(clients), "band").withColumn("defaults", F.col("default_share") * F.col("clients"))
    return out.select("band", "month", "defaults", (F.col("defaults") * loss / 1e6).alias("loss_millions"))


def provisions(projection: DataFrame, clients: DataFrame, loss: float = LOSS_PER_DEFAULT) -> DataFrame:
    """initial_defaults, final_defaults, increment, increment_pct, additional_provisions."""
    rows = projected_loss(projection, clients, loss)
    ends = rows.groupBy("band").agg(F.min_by("defaults", "month").alias("a"), F.max_by("defaults", "month").alias("b"))
    out = ends.agg(F.sum("a").alias("initial_defaults"), F.sum("b").alias("final_defaults")).withColumn("increment", F.col("final_defaults") - F.col("initial_defaults"))
    return out.withColumns({"increment_pct": F.col("increment") / F.nullif("initial_defaults", F.lit(0.0)) * 100, "additional_provisions": F.col("increment") * loss})


def initial_state(default: Column, band: Column, ratio: Column, months: Column) -> Column:
    """Rule-based state number: default, or strained debt and recent arrears by band, or current."""
    strained = F.when(band <= 2, (ratio > 1.5) | (months < 3)).otherwise((ratio > 2.0) & (months < 1))
    return F.when(default == 1, 2).when(strained, 1).otherwise(0)


def stacked(projection: DataFrame) -> DataFrame:
    """Upper edges of the stacked shares: current, with arrears, with default."""
    return projection.select("band", "month", F.col("current").alias("upto_current"), (F.col("current") + F.col("arrears")).alias("upto_arrears"), (F.col("current") + F.col("arrears") + F.col("default_share")).alias("upto_default"))


def empirical_transitions(df: DataFrame, entity: str, state: str, order: Sequence[str]) -> DataFrame:
    """(from_state, to_state, n, p) between consecutive rows of each entity."""
    w = Window.partitionBy(entity).orderBy(*order)
    steps = df.select(F.col(state).alias("from_state"), F.lead(state).over(w).alias("to_state")).where("to_state IS NOT NULL")
    counts = steps.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def arrears_kpis(df: DataFrame, entity: str, state: Column, order: Sequence[str]) -> DataFrame:
    """One row: migration_rate (of steps from current, into arrears), cure_rate (of steps from arrears, into current), default_rate (of steps from either, into default) and mean_steps_in_arrears (rows in arrears a spell). state: 0 current, 1 arrears, 2 default."""
    w = Window.partitionBy(entity).orderBy(*order)
    rows = df.select(state.alias("s"), F.lag(state).over(w).alias("before"), F.lead(state).over(w).alias("next"))
    count = lambda c: F.sum(c.cast("long"))
    step = F.col("next").isNotNull()
    one = rows.agg(
        count(step & (F.col("s") == 0)).alias("from_current"),
        count(step & (F.col("s") == 1)).alias("from_arrears"),
        count((F.col("s") == 0) & (F.col("next") == 1)).alias("migrated"),
        count((F.col("s") == 1) & (F.col("next") == 0)).alias("cured"),
        count((F.col("s") < 2) & (F.col("next") == 2)).alias("defaulted"),
        count(F.col("s") == 1).alias("in_arrears"),
        count((F.col("s") == 1) & (F.coalesce(F.col("before"), F.lit(-1)) != 1)).alias("spells"),
    )
    return kpi_shares(one)


def kpi_shares(counts: DataFrame) -> DataFrame:
    """The rates of ``arrears_kpis`` from its counts."""
    share = lambda a, b: F.col(a) / F.nullif(b, F.lit(0)).cast("double")
    c = F.col
    return counts.select(share("migrated", c("from_current")).alias("migration_rate"), share("cured", c("from_arrears")).alias("cure_rate"), share("defaulted", c("from_current") + c("from_arrears")).alias("default_rate"), share("in_arrears", c("spells")).alias("mean_steps_in_arrears"))


def observed_transitions(df: DataFrame, entity: str, band: Column, state: Column, order: Sequence[str]) -> DataFrame:
    """(band, from_state, to_state, p) of all nine cells, estimated from consecutive rows of each entity; state 0 current, 1 arrears, 2 default.

    Default absorbs: what follows it isn't counted, and its row is (0, 0, 1). A state that a band is never seen to leave stays as it is. The band of a step
    is that of its first row. Rows without an entity, band or state are left out.
    """
    rows = df.select(F.col(entity).alias("__e"), band.cast("int").alias("band"), state.cast("int").alias("s"), *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order))).dropna(subset=["__e", "band", "s"])
    w = Window.partitionBy("__e").orderBy(*(f"__o{k}" for k in range(len(order))))
    steps = rows.select("band", "s", F.lead("s").over(w).alias("t")).groupBy("band", "s", "t").agg(F.count("*").alias("n"))
    # at most twelve counts a band from here on
    cell = lambda i, j: F.coalesce(F.sum(F.when((F.col("s") == i) & (F.col("t") == j), F.col("n"))), F.lit(0)).cast("double")
    counts = steps.groupBy("band").agg(F.array(*(F.array(*(cell(i, j) for j in range(3))) for i in range(2))).alias("__n"))
    cells = []
    for i in range(3):
        for j in range(3):
            whole = F.aggregate(F.col("__n")[i], F.lit(0.0), lambda a, b: a + b) if i < 2 else None
            p = F.lit(float(j == 2)) if i == 2 else F.when(whole > 0, F.col("__n")[i][j] / F.nullif(whole, F.lit(0.0))).otherwise(float(i == j))
            cells.append(F.struct(F.lit(i).alias("from_state"), F.lit(j).alias("to_state"), p.alias("p")))
    return counts.select("band", F.explode(F.array(*cells)).alias("x")).select("band", "x.*")


def observed_start(df: DataFrame, entity: str, band: Column, state: Column, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The portfolio as it stands: (band, state, p), the shares of the entities' latest states, and (band, clients). The band is that of an entity's latest row."""
    rows = df.select(F.col(entity).alias("__e"), F.struct(band.cast("int").alias("band"), state.cast("int").alias("s")).alias("x"), F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order))).alias("__o"))
    rows = rows.where("__e IS NOT NULL AND x.band IS NOT NULL AND x.s IS NOT NULL")
    latest = rows.groupBy("__e").agg(F.max_by("x", "__o").alias("x")).select("x.*")
    counts = latest.groupBy("band").agg(F.count("*").alias("clients"), *(F.sum((F.col("s") == i).cast("long")).alias(f"s{i}") for i in range(3)))
    shares = F.explode(F.array(*(F.struct(F.lit(i).alias("state"), (F.col(f"s{i}") / F.col("clients")).alias("p")) for i in range(3))))
    return counts.select("band", shares.alias("x")).select("band", "x.*"), counts.select("band", "clients")
