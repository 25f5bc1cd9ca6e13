"""Registered queries."""

from quern.plans import features, registry, workflows  # noqa: F401
