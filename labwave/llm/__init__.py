"""Operators and queries for preparing large text corpora.

One module per operator, plain functions ``DataFrame -> DataFrame``; nothing
else in the library imports this subpackage.
"""
