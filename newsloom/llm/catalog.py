"""Importing this module registers the queries of this package."""

import corpus_pipeline
from newsloom.llm import (  # noqa: F401
    bpe,
    imatch,
    language_id,
    minhash,
    mixing,
    multi_index,
    periodic_runs,
    quality,
    secrets,
    spelling,
    suffixes,
    token_store,
    line_dedup,
)
from newsloom.llm.common import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
