"""Document retrieval and recommendation analytics as Spark DataFrame plans."""
