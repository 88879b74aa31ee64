"""Operators that prepare text corpora for language-model training.

Every operator takes and returns DataFrames and names the columns it reads, so
other columns of the input never clash with its own.
"""
