import time

from pyspark.sql import functions as F

from plinth.session import cut, empty, within


def shuffled(spark) -> int:
    """Shuffle files on the disk."""
    jvm = spark.sparkContext._jvm
    files = jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
    return sum(f.getName().startswith("shuffle_") for f in files)


def test_no_shuffle_files_stay_behind_a_step(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = shuffled(spark)
    kept = cut(counted)
    assert not empty(counted) and within(counted, 10) and not within(counted, 9)
    for _ in range(50):
        if shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled(spark) <= before
    assert kept.agg(F.sum("count")).first()[0] == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
