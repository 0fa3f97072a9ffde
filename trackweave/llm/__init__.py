"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``trackweave.llm.queries`` holds
the registered queries and ``trackweave.llm.oracles`` their SQL.
"""
