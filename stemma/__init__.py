"""Document-graph analytics expressed as Spark DataFrame plans."""
