"""Program-fact analytics on Spark: facts in as tables, verdicts out as tables."""
