"""attestor: compliance-data analytics expressed as Spark DataFrame plans."""
