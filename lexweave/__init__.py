"""Corpus-linguistics and measured-tone analytics as Spark DataFrame jobs."""
