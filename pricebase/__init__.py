"""Unit-price analytics on Spark: ``DataFrame -> DataFrame`` jobs over the whole catalogue."""
