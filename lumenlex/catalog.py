"""Every query of the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from lumenlex.plans import relational, retrieval

QUERIES: dict = relational.QUERIES | retrieval.QUERIES
ORACLES: dict = relational.ORACLES | retrieval.ORACLES
