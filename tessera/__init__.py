"""Catalogue matching and quotation analytics on Spark, and operators for training corpora."""
