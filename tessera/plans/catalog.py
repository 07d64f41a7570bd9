"""All queries of the engine and their SQL."""

from __future__ import annotations

from tessera.plans import persisted, relational, retrieval, store, texts

QUERIES = {**retrieval.Q, **store.Q, **persisted.Q, **texts.Q, **relational.Q}
SQL = {**retrieval.SQL, **store.SQL, **persisted.SQL, **texts.SQL, **relational.SQL}
