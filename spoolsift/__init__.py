"""Transcript analytics on Spark: read, normalise, search, count and mask coding-agent session logs."""

from spoolsift.session import prepare

__all__ = ["prepare"]
