"""Interval and text analytics on Spark: lazy DataFrame operators keyed by source and ordinal."""
