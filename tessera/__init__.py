"""Spark-native operators for media-derived text: transcripts, documents, pages, vectors and their catalog."""
