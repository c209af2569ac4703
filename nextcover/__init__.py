"""Next-product analytics on client policy data, written as Spark DataFrame jobs."""
