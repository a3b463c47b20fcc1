"""Document-corpus analytics on Spark: bibliographic tables, manuscripts, citations, text quality, privacy."""
