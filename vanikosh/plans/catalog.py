"""The queries of the core, by name."""

from __future__ import annotations

from vanikosh.operators import intervals
from vanikosh.plans import cleanup, files, quality, words
from vanikosh.streaming import segments

FLAGSHIP = "corpus_wer_by_lang"
_MODULES = (intervals, words, cleanup, quality, files, segments)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in getattr(m, "SQL", {}).items()}
