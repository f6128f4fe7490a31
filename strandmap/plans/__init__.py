"""Queries on the supplied tables and whole reduction plans."""

from . import checks, extra, maps, round_trips, streams  # noqa: F401  they register their queries
