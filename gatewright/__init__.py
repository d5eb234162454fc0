"""A Spark-first engine for routing decisions between a cheap classifier and an expensive model, and for measuring them."""
