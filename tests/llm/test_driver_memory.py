"""What operators hold on the driver."""

import tracemalloc

from pyspark.sql import functions as F

from tripleloom.llm import toxicity


def test_toxicity_examples_stay_compact(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.concat(F.lit("w"), F.translate((F.col("id") * 500 + i).cast("string"), "0123456789", "abcdefghij"))))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), words.alias("text"))
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    tracemalloc.start()
    try:
        found = toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found.wide.terms) > 150_000
    assert peak < 700 * len(found.wide.terms), peak / len(found.wide.terms)
