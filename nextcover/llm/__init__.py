"""Operators for preparing training data, each a Spark job over a table of documents or vectors."""
