"""Operators for training-data corpora: filters, deduplication, language models and packing.

Every operator is a function over DataFrames with its own column names as parameters. The modules
also hold the driver queries ``opN_<name>`` and, where SQL can express them, their DuckDB texts;
``registry`` gathers both.
"""
