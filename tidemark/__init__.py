"""tidemark: interval, sequence and annotation analytics as Spark DataFrame operators."""
