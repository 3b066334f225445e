"""One key holding a third of the rows: whole results, and joins that split it."""

import random
from collections import Counter, defaultdict
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import functions as F

from tests.conftest import rows_of
from wordloom.operators import anagram_queries as anagrams
from wordloom.operators import corpus_queries as corpora
from wordloom.operators import links, paradigm_queries
from wordloom.plans import ingest
from wordloom.schema import MODEL


@contextmanager
def settings(spark, **values):
    """Small thresholds, so that small data is skewed, and no broadcast."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


SKEWED = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "10KB",
    "spark__sql__adaptive__coalescePartitions__minPartitionSize": "1KB",
}


def hot_words(n=30_000):
    random.seed(4)
    return [(f"word{i:06d}", 7 if i % 3 == 0 else 1000 + i // 4) for i in range(n)]


def model_of(spark, words):
    table = spark.createDataFrame([(w, w, h) for w, h in words], MODEL["words"])
    return replace(ingest.empty_model(spark), words=table.repartition(6))


def test_anagram_classes(spark):
    words = hot_words()
    model = model_of(spark, words)
    sizes = Counter(h for _, h in words)
    with settings(spark, **SKEWED):
        found = anagrams.anagram_variants(model)
        numbers = found.groupBy("anahash").agg(
            F.count(F.lit(1)), F.count_distinct("variant_id"), F.max("variant_id"))
        assert rows_of(numbers) == sorted((h, n, n, n - 1) for h, n in sizes.items())
        joined = found.filter("variant_id >= 0")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_confusions_into_a_hot_class(spark):
    words = hot_words(3000)
    model = model_of(spark, words)
    steps = [2, 993, 1000]
    confusions = spark.createDataFrame([(s,) for s in steps], "confusion LONG")
    by_hash = defaultdict(list)
    for w, h in words:
        by_hash[h].append(w)
    expected = sorted(
        (h, s, w) for h in by_hash for s in steps for w in by_hash.get(h + s, []))
    with settings(spark, **SKEWED):
        assert rows_of(anagrams.confusion_neighbours(model, confusions)) == expected


def test_a_pair_repeated_many_times(spark):
    pairs = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("x"), "id")).alias("f"),
        F.lit("b").alias("t"), F.col("id").alias("at"))
    directed = links.both_directions(pairs, "f", "t", ["at"], order_by="at")
    assert directed.count() == 2 * 20_001
    assert rows_of(directed.filter("wordform_from = 'a'"), "at") == [(0,)]


def test_one_corpus_with_most_documents(spark):
    """A document in two corpora counts twice without a corpus filter."""
    n = 3000
    ids = spark.range(n)
    model = replace(
        ingest.empty_model(spark),
        documents=ids.select(*[
            {"document_id": F.col("id"), "word_count": F.lit(10).cast("long"),
             "pub_year": F.lit(1900).cast("long") + F.col("id") % 2,
             "title": F.concat(F.lit("d"), "id")}.get(
                f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in MODEL["documents"].fields]),
        corpora=spark.createDataFrame([(1, "big"), (2, "small")], MODEL["corpora"]),
        corpus_documents=ids.select(F.lit(1).cast("long").alias("corpus_id"),
                                    F.col("id").alias("document_id")).unionByName(
            ids.filter("id < 100").select(F.lit(2).cast("long").alias("corpus_id"),
                                          F.col("id").alias("document_id"))),
        attestations=ids.select(F.lit("the").alias("wordform"), F.col("id").alias("document_id"),
                                F.lit(2).cast("long").alias("frequency")),
    )
    with settings(spark, **SKEWED):
        assert rows_of(corpora.word_in_corpora(model)) == [
            ("the", "big", n, 2 * n), ("the", "small", 100, 200)]
        assert rows_of(corpora.word_frequency_per_year(model, "the")) == [
            ("the", 1900, 1e9 * 2 / 10), ("the", 1901, 1e9 * 2 / 10)]
        assert rows_of(corpora.count_unique_words_per_corpus(model)) == [
            ("big", 1, 2 * n), ("small", 1, 200)]


def test_network_limits_before_the_shuffle(spark):
    from wordloom.plans.workload import Workload

    nodes, _ = paradigm_queries.paradigm_network(
        Workload.of(spark, "/root/testdata/sf0.001"), ["thing", "ertion"])
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 50, Partial" in plan
