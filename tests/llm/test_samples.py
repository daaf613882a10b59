"""What models are fitted on is bounded by rows and bytes, whatever ids repeat."""

from pyspark.sql import functions as F

from pulseframe.llm import common, quality, toxicity


def test_what_is_collected_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    taken = []
    keep = common.sample_texts

    def watched(*args):
        taken.append(keep(*args))
        return taken[-1]

    monkeypatch.setattr(quality, "sample_texts", watched)
    monkeypatch.setattr(toxicity, "sample_texts", watched)
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some plain words "), F.col("id").cast("string")).alias("text"))
    other = spark.range(100, 160).select(F.col("id").alias("doc_id"), F.repeat(F.lit("more words. "), 100).alias("text"))
    docs = same.unionByName(other)
    quality.fit(docs, sample=10)
    assert 1 <= len(taken[-1]) <= 10
    quality.fit(docs, sample=100, most=5000)
    assert sum(len(r.body) for r in taken[-1]) <= 5000 and len(taken[-1]) >= 4
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    toxicity.fit(docs, labels, sample=1)
    assert len(taken[-1]) <= 1
    toxicity.fit(docs, labels, sample=20, most=3000)
    assert len(taken[-1]) <= 20 and sum(len(r.body) for r in taken[-1]) <= 3000
    assert len({r.doc_id for r in taken[-1]}) == len(taken[-1])
