"""Corpus preparation, labelled data sets and evaluation as Spark DataFrame jobs."""
