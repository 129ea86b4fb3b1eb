"""Operators of a training-data pipeline over documents, pages, vectors and conversations.

Nothing outside this folder imports it. Each operator takes and returns DataFrames and keeps a general
interface; ``queries`` applies them to whole tables.
"""
