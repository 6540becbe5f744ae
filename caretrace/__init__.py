"""Care-episode analytics expressed as Spark DataFrame operators."""
