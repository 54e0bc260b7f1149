import pytest
from pyspark.sql import functions as F

from terseframe.operators import account as ac, evaluate as ev, vectors as vq


@pytest.mark.parametrize("p,g,f1", [("the cat", "a cat", 1.0), ("", "", 1.0), ("the", "cat", 0.0), ("cat sat", "cat", 2 / 3), ("dog", "cat", 0.0)])
def test_token_f1(spark, p, g, f1):
    df = spark.createDataFrame([(p, [g])], "p string, g array<string>")
    assert df.select(ev.best_f1(F.col("p"), F.col("g")).alias("f")).first()["f"] == pytest.approx(f1)


def test_faults(spark):
    rows = [(True, "x"), (False, "red fox den"), (False, "nothing")]
    df = spark.createDataFrame([(c, ["red fox"], t, "") for c, t in rows], "c boolean, g array<string>, t string, d string")
    out = [r["f"] for r in df.select(ev.fault(F.col("c"), F.col("g"), F.col("t"), F.col("d")).alias("f")).collect()]
    assert out == ["", "READER_ERROR", "INFO_LOST_IN_COMPRESSION"]


def test_size_factors():
    factor = lambda d, b, n=0, ob=0: 16 * d / ((d - n) * b + n * ob + (64 if ob > b else 32))
    assert factor(128, 4) == pytest.approx(3.765, abs=1e-3)
    assert factor(128, 3, 32, 4) == pytest.approx(4.267, abs=1e-3)
    assert vq.effective_bits(128, 3, 32, 4) == 3.25


def test_size_report_matches_the_formula(spark):
    df = spark.createDataFrame([([0.5] * 128,)], "embedding array<float>")
    rows = {r["bits"]: r["factor"] for r in vq.size_report(df, 128, [(4, 0, 0), (3, 32, 4)]).collect()}
    assert rows[4] == pytest.approx(2048 / 544, abs=1e-6) and rows[3] == pytest.approx(2048 / 480, abs=1e-6)


def test_rotation_is_orthogonal():
    import numpy as np

    m = vq.rotation(64)
    assert np.allclose(m @ m.T, np.eye(64))


@pytest.mark.parametrize("bits,bound", [(1, 0.40), (2, 0.13), (3, 0.04), (4, 0.012)])
def test_distortion_is_below_the_published_bound(spark, sf, bits, bound):
    rows = vq.distortion(vq.round_trip(spark.read.parquet(f"{sf}/embeddings.parquet"), 64, bits), [])
    assert rows.first()["relative_mse"] < bound


def test_sparkline_needs_two_points(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("b", 0, 0.2), ("b", 1, 0.6)], "k string, o bigint, ratio double")
    got = sorted((r["k"], r["o"], r["y"]) for r in ac.sparkline(df, ["k"], "o").collect())
    assert got == [("b", 0, 1.0), ("b", 1, 0.0)]


def test_lookup_paths_agree(spark):
    from terseframe.operators import lookup as lk

    rows = spark.range(2000).select((F.col("id") % 50).cast("string").alias("term"), "id")
    table = rows.groupBy("term").agg(F.count("*").alias("count"))
    hot = table.filter("term < '2'")
    small = lk.lookup(rows, table, "term", 50)
    large = lk.lookup(rows, table, "term", lk.SMALL_BYTES + 1, hot)
    assert sorted(map(tuple, small.select("id", "count").collect())) == sorted(map(tuple, large.select("id", "count").collect()))


def test_frequent_terms_fill_the_limit(spark):
    from terseframe.operators.lookup import ROW_BYTES, frequent, lookup

    table = spark.createDataFrame([(f"{i:04}", 2 ** (i % 8)) for i in range(800)] + [("z" * 300, 10**6)], "term string, count long")
    each = ROW_BYTES + 4
    got = [r["count"] for r in frequent(table, "count", 10**6, 250 * each).collect()]
    assert sorted(set(got)) == [64, 128] and len(got) == 200
    assert frequent(table, "count", 10**6, each).count() == 0 and frequent(table, "count", 100, 100).count() == 801
    rows = table.select("term")
    for limit in (each, 250 * each):
        met = lookup(rows, table, "term", 10**6, frequent(table, "count", 10**6, limit), limit)
        assert sorted(map(tuple, met.collect())) == sorted(map(tuple, table.collect()))
