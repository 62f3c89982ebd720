"""Operators for building language-model training data at corpus scale.

Nothing outside this subpackage imports it; queries and their SQL twins are
gathered in :mod:`boxwood.llm.queries`.
"""
