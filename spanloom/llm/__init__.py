"""Operators for preparing language-model training data, as Spark plans.

Nothing outside this subpackage imports it; its queries are in
``spanloom.llm.queries``.
"""
