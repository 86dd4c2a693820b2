"""Whole dates come back from the time at which a tempo reaches them, also beside the dates where the rule's steps change."""

from pyspark.sql import functions as F

from tactuslab.functions import kernels


def test_every_date(spark):
    # Steep transitions: at 360 the time by four steps is one that two steps give some ticks before.
    tempos = spark.createDataFrame([(60.0, 190.0, 0.2), (96.0, 61.0, 0.2), (100.0, 187.0, 0.4), (63.0, 187.0, 0.3), (90.0, 70.0, 0.8)], "bpm double, t double, m double")
    rows = tempos.crossJoin(spark.range(2880).select(F.col("id").cast("double").alias("d")))
    rest = [F.lit(0.0), F.lit(2880.0), F.col("bpm"), F.lit(0.25), F.col("t"), F.col("m")]
    back = kernels.with_dates(rows, "back", kernels.ms_at(F.col("d"), *rest), *rest)
    assert back.where("back <> d OR back IS NULL").collect() == []
