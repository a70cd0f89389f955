"""Queries on the given tables, one or more for every operator."""

from . import events, functions, messages, reads, reports, streams, writes  # noqa: F401

FLAGSHIP = "build_outbox"
