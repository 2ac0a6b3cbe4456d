"""A bounded sample of the labelled documents that models may learn from."""

from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import held_out
from sessionloom.sources.scratch import save_scratch

SAMPLE_FILES = 16


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """``(doc_id, text, y)`` of at most ``per_class`` documents of each label, and both labels' rows in all and in the sample.

    Held-out rows, labels other than 0 and 1, and ids with differing labels take no part. The
    sample is the rows with the smallest hash of their id, so it is even over the table and
    the same on every run. Only its ids reach the driver; of an id that several rows share
    the text with the smallest hash counts.
    """
    one = (
        labels.where(~held_out("doc_id") & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("top")).where("y = top").select("doc_id", "y")
    )
    known = one.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("turn", F.xxhash64("doc_id"))
    totals = {y: n for y, n in known.groupBy("y").count().collect()}
    picked = [known.where(F.col("y") == y).orderBy("turn", "doc_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].union(picked[1]).select("doc_id", "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    text = F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text")
    sample = save_scratch(rows.groupBy("doc_id", "y").agg(text).repartition(SAMPLE_FILES), "sample")
    return sample, totals, {y: n for y, n in sample.groupBy("y").count().collect()}
