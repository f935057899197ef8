"""tidemark: a Spark-native analytics engine for streams and batches of postings."""
