"""Security-log analytics on Spark: parse, normalise, detect, de-duplicate, store, query."""
