"""Sizes as text."""

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import summaries


def test_half_a_hundredth_goes_to_the_even_one(spark):
    sizes = [1023, 1024, 1152, 1408, 6272, 928896, (1 << 20) + (1 << 17), (1 << 30) * 3 + (1 << 27) * 3]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long").orderBy("i")
    assert [r[0] for r in df.select(text.format_bytes(F.col("n"))).collect()] == ["1023 B", "1.00 KB", "1.12 KB", "1.38 KB", "6.12 KB", "907.12 KB", "1.12 MB", "3.38 GB"]


def test_plan_text_rounds_like_its_sql(spark):
    plan = spark.createDataFrame([("a", "create", 1152), ("b", "update", 6272), ("c", "delete", None), ("d", "skip", 1152)], "path string, action string, src_size long")
    assert {r.text for r in summaries.plan_text(plan).collect()} == {"Would create: a (1.12 KB)", "Would update: b (6.12 KB)", "Would delete: c"}
