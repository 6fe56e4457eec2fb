"""Spark-first analytics over document corpora: DataFrame in, DataFrame out."""
