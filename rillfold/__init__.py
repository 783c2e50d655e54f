"""Change-log processing on Spark: scan, order, de-duplicate, replay and plan over CDC logs."""
