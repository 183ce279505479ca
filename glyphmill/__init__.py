"""glyphmill: a Spark-first engine for tokenizer, corpus and evaluation analytics."""
