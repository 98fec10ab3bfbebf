"""Importing this module registers the package's queries."""

import corpus_pipeline
from rungkit.llm import q_ann, q_classify, q_dedup, q_merkle, q_mix, q_phrases, q_text  # noqa: F401
from rungkit.llm.common import ORACLE, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
