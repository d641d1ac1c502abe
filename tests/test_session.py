"""What may be broadcast is measured, nested and binary columns too."""

from pyspark.sql import functions as F

from tickloom.session import fits_broadcast


def test_fits_broadcast_measures_what_columns_hold(spark):
    rows = spark.range(1_000)
    wide = rows.select("id", F.array_repeat(F.lit("x" * 1_000), 100).alias("a"))
    assert fits_broadcast(rows) and not fits_broadcast(rows, max_rows=999) and fits_broadcast(wide.limit(0))
    assert not fits_broadcast(wide) and not fits_broadcast(rows.select(F.struct(F.lit("y" * 9_000)).alias("s")))
    binary = rows.select(F.encode(F.repeat(F.lit("b"), 1_000), "UTF-8").alias("b"))
    assert fits_broadcast(binary, max_bytes=1_100_000) and not fits_broadcast(binary, max_bytes=900_000)
