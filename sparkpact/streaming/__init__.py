"""Contracts on streams. A contract keeps no state, so any engine method takes a streaming frame as it is."""

from .quarantine import quarantine_stream

__all__ = ["quarantine_stream"]
