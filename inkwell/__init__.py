"""inkwell: document and digest analytics expressed as Spark DataFrame plans."""
