"""Small helper that ties a query to its SQL check."""

from __future__ import annotations


def registry():
    queries, oracle = {}, {}

    def query(name: str, text: str | None = None):
        def register(fn):
            queries[name] = fn
            if text is not None:
                oracle[name] = text
            return fn
        return register

    return queries, oracle, query
