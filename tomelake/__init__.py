"""tomelake: shelf-scan resolution analytics expressed as Spark DataFrame plans."""
