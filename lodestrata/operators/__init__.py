"""Operators over tables of documents, questions and messages."""
