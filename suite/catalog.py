"""Importing this module registers every query."""

from suite import aggregates, daily, filters, ingest, issues, joins, knowledge, layout, similarity, streams  # noqa: F401
