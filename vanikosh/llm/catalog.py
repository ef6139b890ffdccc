"""The queries of this package, by name."""

from __future__ import annotations

from vanikosh.llm import bpe, canon, language, mix, spam, terms, turns

_MODULES = (canon, terms, turns, language, bpe, mix, spam)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in getattr(m, "SQL", {}).items()}
