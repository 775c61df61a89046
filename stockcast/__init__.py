"""Daily retail demand analytics on Spark: panel, features, walk-forward evaluation, order quantities."""
