"""lodestone: a Spark-first engine for building and evaluating retrieval corpora."""
