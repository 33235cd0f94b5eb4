from pyspark.sql import functions as F

from scoreloom.operators.markov import CLIENTS, DEFAULTS
from scoreloom.operators.relational import validate_counts
from scoreloom.sources import synthetic, tables
from scoreloom.streaming import monitor


def test_leads(spark, tmp_path):
    df = synthetic.leads(spark, 5000).cache()
    row = df.agg(F.count("*").alias("n"), F.min("monthly_income").alias("lo"), F.max("monthly_income").alias("hi"), F.avg("converted").alias("rate"), F.min("age").alias("a"), F.max("employment_tenure").alias("t"), F.avg((F.col("employment_type") == "Salaried").cast("int")).alias("s")).first()
    assert row.n == 5000 and row.lo >= 3000 and row.hi <= 50000 and row.a >= 18 and row.t <= 360
    assert 0.015 < row.rate < 0.06 and abs(row.s - 0.5) < 0.04
    assert df.where("income_bin IS NULL").count() == 0
    later = synthetic.leads(spark, 3000, 123, production=True)
    assert "income_bin" not in later.columns and dict(later.dtypes)["employment_tenure"] == "double"
    tables.write_csv(df.drop("income_bin"), f"{tmp_path}/leads")
    back = tables.read_csv(spark, f"{tmp_path}/leads", ", ".join(f"{n} {t}" for n, t in df.drop("income_bin").dtypes))
    assert back.count() == 5000 and back.agg(F.sum("age")).first() == df.agg(F.sum("age")).first()


def test_portfolio(spark):
    df = synthetic.portfolio(spark)
    targets = spark.createDataFrame([(b, CLIENTS[b], DEFAULTS[b]) for b in CLIENTS], "banda int, rows long, flagged long")
    rows = validate_counts(df, targets, "banda", "default").collect()
    assert len(rows) == 5 and all(r.rows_off == r.flagged_off == 0 for r in rows)
    assert df.select("cliente_id").distinct().count() == 9200
    assert df.agg(F.min("score_comportamiento")).first()[0] >= 300


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, g string")
    tables.write_parquet(df, f"{tmp_path}/t.parquet", ("g",))
    assert sorted(r.x for r in tables.table(spark, str(tmp_path), "t").where("g = 'a'").collect()) == [1]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-0{d} 10:00:00", float(v)) for d in (1, 2) for v in range(10)] + [("2024-01-09 10:00:00", 1.0)], "t string, v double").select(F.col("t").cast("timestamp").alias("ts"), "v")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    counts = monitor.binned_counts(stream, "ts", "v", [0, 5, 10])
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table("counts")
    assert sorted((str(r.start)[:10], r.bin, r.n) for r in rows.collect())[:4] == [("2024-01-01", 0, 5), ("2024-01-01", 1, 5), ("2024-01-02", 0, 5), ("2024-01-02", 1, 5)]
    psi = {str(r.start)[:10]: r.psi for r in monitor.window_psi(rows, [0.5, 0.5]).collect()}
    assert psi["2024-01-01"] == 0 and psi["2024-01-09"] > 1
