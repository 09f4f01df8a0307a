"""textloom: DataFrame operators for serialized text corpora on Spark."""
