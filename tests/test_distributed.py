import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shopmetrics.operators import distributed as d


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 12, 23, 1500])
def test_ntile_matches_the_window(spark, n):
    df = spark.range(n).select("id", (F.col("id") * 37 % 11).alias("v"))
    got = d.ntile_global(df, [d.Key("v"), d.Key("id")], 5, "b")
    want = df.withColumn("w", F.ntile(5).over(Window.orderBy("v", "id")))
    assert got.join(want, ["id", "v"]).filter("b = w").count() == n == got.count()


@pytest.mark.parametrize(("bins", "few"), [(2048, 4096), (16, 10), (64, 0)])
def test_ntile_by_selection_splits_heavy_ties(spark, monkeypatch, bins, few):
    monkeypatch.setattr(d, "BINS", bins)
    monkeypatch.setattr(d, "FEW_ROWS", few)
    value = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 7919 % 1000 - 500)
    df = spark.range(6000).select("id", value.cast("decimal(22,2)").alias("v"), F.expr("id % 2 = 0").alias("b"))
    for key, col in [
        (d.Key("v", nulls_last=True), F.col("v").asc_nulls_last()),
        (d.Key("v"), F.col("v").asc_nulls_first()),
        (d.Key("v", descending=True, nulls_last=True), F.col("v").desc_nulls_last()),
        (d.Key("b", descending=True), F.col("b").desc_nulls_first()),
    ]:
        got = d.ntile_global(df, [key, d.Key("id", descending=True)], 7, "t")
        want = df.withColumn("w", F.ntile(7).over(Window.orderBy(col, F.col("id").desc())))
        assert got.join(want.select("id", "w"), "id").filter("t = w").count() == 6000


def test_ntile_over_moments_and_days(spark):
    moment = F.expr("timestampadd(MILLISECOND, id * 86399377 % 400000000, timestamp_ntz'2025-11-01 00:00:00')")
    df = spark.range(3000).select("id", moment.alias("at"), F.to_date(moment).alias("day"), moment.cast("timestamp").alias("zoned"))
    for c in ("at", "day", "zoned"):
        got = d.ntile_global(df, [d.Key(c), d.Key("id")], 4, "t")
        want = df.select("id", F.ntile(4).over(Window.orderBy(c, "id")).alias("w"))
        assert got.join(want, "id").filter("t = w").count() == 3000
    with pytest.raises(TypeError):
        d.ntile_global(df.withColumn("s", F.lit("x")), [d.Key("s"), d.Key("id")], 4)


def test_ntile_neither_sorts_nor_moves_the_rows(spark):
    plan = d.ntile_global(spark.range(1000), [d.Key("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_numbers_with_one_dominant_value(spark):
    # A third of the rows and more share one value; the id splits them over partitions.
    df = spark.range(30000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 100).alias("v"))
    got = d.assign_row_numbers(df, [F.col("v").asc(), F.col("id").asc()], "rn")
    want = df.withColumn("w", F.row_number().over(Window.orderBy("v", "id")))
    assert got.join(want, ["id", "v"]).filter("rn = w").count() == 30000


def test_rank_top_puts_nulls_last(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 5), ("d", 5)], "k string, v int")
    got = sorted((r["rank"], r.k) for r in d.rank_top(df, "v", ["k"]).collect())
    assert got == [(1, "c"), (2, "d"), (3, "a"), (4, "b")]


def test_top_with_rest_reads_its_input_once(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 7).cast("string").alias("k"), "id").write.parquet(str(tmp_path / "t"))
    src = spark.read.parquet(str(tmp_path / "t"))
    agg = src.groupBy("k").agg(F.sum("id").alias("s"), F.count("*").alias("n"))
    out = d.top_with_rest(agg, "k", "s", ["s", "n"], 2, "rest")
    assert {r.k: r.n for r in out.collect()} == {"5": 143, "4": 143, "rest": 714}
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {r.k: str(r.s) for r in d.share_of_total(df, "v", "s").collect()} == {"a": "33.33", "b": "66.67"}
