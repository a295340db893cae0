"""All queries of this subpackage, with the pipeline that uses it."""

from __future__ import annotations

import corpus_pipeline
from trailgraph.llm.queries import ORACLES as _SQL, QUERIES as _QUERIES

QUERIES = dict(_QUERIES)
ORACLES = dict(_SQL)
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
