"""Many documents against a short history."""

from pyspark.sql import functions as F

from kontor.llm import exact_dedup


def test_short_history_is_spread(spark, monkeypatch):
    """200,000 rows asked against a history of one take about 200 shards, and find that one."""
    seen = []
    lookup = exact_dedup.looked_up
    monkeypatch.setattr(exact_dedup, "looked_up", lambda digests, index, shards: seen.append(shards) or lookup(digests, index, shards))
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 150_000).alias("text"))
    history = spark.createDataFrame([(-1, "te xt7")], "doc_id long, text string")
    groups = exact_dedup.exact_groups(docs, history)
    assert groups.filter("kept").count() == 149_999
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in groups.filter("doc_id % 150000 IN (7, 8)").collect()) == [
        (7, -1, 1, False), (8, 8, 2, True), (150_007, -1, 1, False), (150_008, 8, 2, False)]
    assert 150 < seen[0] < 250
