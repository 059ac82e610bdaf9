"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``terrazzo.llm.queries`` holds the
registered queries and their SQL.
"""
