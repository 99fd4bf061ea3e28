"""Media-library analytics expressed as Spark DataFrame plans."""
