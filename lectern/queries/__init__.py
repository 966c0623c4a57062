"""Registered queries of the engine, by subject."""

from lectern.queries import analytics, answers, checks, documents, records, retrieval, rules, streams, web  # noqa: F401
