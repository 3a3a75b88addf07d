"""Change logs, type-2 history, keyed upserts and table recovery as Spark DataFrame operators."""
