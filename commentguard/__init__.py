"""Target-aware comment moderation as Spark DataFrame operators."""
