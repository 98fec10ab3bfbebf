"""Query catalog: importing this package registers every query."""

from rungkit.plans import (q_curriculum, q_eval, q_expand, q_prepare, q_scoring, q_seq, q_sources,  # noqa: F401
                           q_stream)
from rungkit.plans.registry import ORACLE, QUERIES  # noqa: F401
