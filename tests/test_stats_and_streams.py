import math

import pytest
from pyspark.sql import functions as F

from stratalog.packs import stats
from stratalog.plans.errors import ProgramError
from stratalog.streaming.monotone import stream


def test_stats(spark):
    low, high = spark.createDataFrame([(8, 10)], "k long, n long").select(stats.wilson(F.col("k"), F.col("n")).alias("w")).select("w.*").first()
    assert (round(low, 4), round(high, 4)) == (0.4902, 0.9433)
    assert stats.binomial_two_sided(1, 8) == pytest.approx(2 * 9 / 256) and stats.binomial_two_sided(0, 0) == 1.0
    rows = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 2)) for i in range(200)], "id long, a int, b int")
    assert stats.mcnemar(rows, "a", "b")[:2] == (50, 0)
    low, high = stats.paired_bootstrap(rows, "a", "b", "id", rounds=300)
    assert low < 0.25 < high and high - low == pytest.approx(2 * 1.96 * math.sqrt(0.25 * 0.75 / 200), rel=0.3)
    assert stats.f1(rows.where("id < 4").select("id"), rows.where("id IN (2, 3, 9)").select("id")) == (0.5, 2 / 3, pytest.approx(4 / 7))
    assert stats.power(0.5, 0.7, 100) == pytest.approx(0.83, abs=0.02)


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 5), (2, 50), (2, 50)], "id long, v long").write.parquet(source)
    rows = spark.readStream.schema("id long, v long").parquet(source)
    names = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    out = stream(spark, "large(I, V) :- event(I, V), V > 10. named(N, V) :- large(I, V), names(I, N).", "named(N, V)", {"event": rows}, {"names": names})
    query = out.writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    spark.createDataFrame([(1, 70), (2, 50)], "id long, v long").write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("answers").collect())) == [("a", 70), ("b", 50)]
    for bad in ("p(X) :- event(X, _), not names(X, _).", "p(X) :- event(X, _). p(X) :- p(X), event(X, _)."):
        with pytest.raises(ProgramError):
            stream(spark, bad, "p(X)", {"event": rows}, {"names": names})
