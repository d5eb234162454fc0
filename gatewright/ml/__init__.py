"""Models on pyspark.ml."""
