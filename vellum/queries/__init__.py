"""Queries over the driver's tables and the SQL that says what they return."""

from __future__ import annotations

from . import corpus, documents, formats

QUERIES: dict = {**corpus.Q, **documents.Q, **formats.Q}
ORACLES: dict[str, str] = {**corpus.SQL, **documents.SQL, **formats.SQL}
