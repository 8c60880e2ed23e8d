"""termweave: approximate string matching and term analytics as Spark DataFrame plans."""
