import __spark_entry__ as entry


def test_names_and_oracles():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "ioi_tempo" in q


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["perf_id", "date", "mid_u", "bpm_u", "weight_u"] and df.count() > 0
