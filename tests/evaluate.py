"""Column functions on literal values."""

from pyspark.sql import functions as F


def one(spark, expr_of, *values):
    """Evaluate a Column function on literal strings."""
    row = spark.range(1).select(expr_of(*[F.lit(v) for v in values]).alias("v")).first()
    return row["v"]
