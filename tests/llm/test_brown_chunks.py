"""Chunks of the class model hold 8 MiB of text, as tasks keep several arrays of a chunk's words."""

from pyspark.sql import functions as F

from merchantry.llm import brown


def test_chunks_are_small_and_numbers_narrow(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("repeat('ab cd e ', 650000)").alias("text"), F.lit(False).alias("held_out"))
    table = brown.cut(docs.coalesce(1), brown.BrownConfig())
    assert table.count() == 2  # 15.6 MB were one chunk
    (c,) = brown.cuts(table.where("words > 0").limit(1).toArrow().to_batches())
    assert c.stream.itemsize == 4 and c.stream[:4].tolist() == [0, 1, 2, 0]
