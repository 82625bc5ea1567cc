"""Document-recommendation analytics expressed as Spark DataFrame plans."""
