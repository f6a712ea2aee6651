import time

from pyspark.sql import functions as F

from scholia.llm import simhash
from scholia.operators.components import connected_components
from scholia.plans.lineage import FREED, durable, written


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.length())) if name.startswith("shuffle_")}


def left_by(spark, run):
    """Shuffle files that stay once all are removed that Spark removes of itself, a little later, after a query."""
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = shuffle_files(spark)
    kept, end = run(), time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    return kept, left


def test_kept_tables_leave_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    for keep in (durable, written):
        was = spark.conf.get(FREED)
        kept, left = left_by(spark, lambda: keep(df))
        assert not left and spark.conf.get(FREED) == was
        assert sum(r["count"] for r in kept.collect()) == sum(r["count"] for r in kept.collect()) == 1000
    assert sum(r["count"] for r in df.collect()) == 1000


def test_rounds_of_components_leave_no_shuffle_files(spark):
    """Before, each round left those of its joins, and many rounds over many partitions filled the disk."""
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    kept, left = left_by(spark, lambda: connected_components(edges))
    assert not left
    assert [tuple(r) for r in kept.groupBy("component").count().collect()] == [(0, 201)]


def test_texts_without_words_bring_no_candidates_together(spark):
    rows = [(1, None), (2, " "), (3, "one"), (4, "one"), (5, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.drop_near_duplicates(df, shingle=5, threshold=0.8).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 5]
