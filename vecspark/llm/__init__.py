"""Training-data operators over documents, conversations and vectors.

Nothing outside this subpackage imports it; ``vecspark.llm.queries`` holds the
registered queries and their SQL.
"""
