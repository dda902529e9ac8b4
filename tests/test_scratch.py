from pyspark.sql import functions as F

from siltstone import scratch


def shuffled(spark):
    """Shuffle files that the session holds."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    before = shuffled(spark)
    frame = spark.range(10000).groupBy(F.pmod(F.col("id"), F.lit(97)).alias("k")).agg(F.sum("id").alias("s"))
    out = scratch.written(frame, "sums")
    assert not shuffled(spark) - before
    assert out.count() == 97 and frame.count() == 97
    assert scratch.written(frame, "sums").agg(F.sum("s")).first()[0] == sum(range(10000))
    assert spark.conf.get(scratch.CLEANUP, "false") == "false"


def test_driver_gives_memory_back_after_writes(spark, monkeypatch):
    given = []
    monkeypatch.setattr(scratch, "_relief", {"at": 0.0}, raising=False)
    monkeypatch.setattr(scratch, "PAUSE", 1000.0, raising=False)
    monkeypatch.setattr(scratch, "trimmed", given.append, raising=False)
    outs = [scratch.written(spark.range(10), "few") for _ in range(3)]
    assert len(given) == 1  # not again before the pause is over
    scratch._relief["at"] = 0.0
    outs.append(scratch.written(spark.range(10), "few"))
    assert len(given) == 2 and all(out.count() == 10 for out in outs)


def test_freed_native_memory_goes_back(spark):
    assert "Trim native heap" in scratch.trimmed(spark)
