"""Corpus lexicography on Spark: from lines of text and dictionary sources to statistics, grammar, search and reports."""
