"""The queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from . import langid, linededup, lm, media, mixing, neardup, neighbours, packing, quality, repair, substrings, toxicity, trie

MODULES = (lm, langid, quality, neardup, packing, mixing, toxicity, media, linededup, substrings, repair, neighbours, trie)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    own = {k: s for m in MODULES for k, s in getattr(m, "ORACLE", {}).items()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
