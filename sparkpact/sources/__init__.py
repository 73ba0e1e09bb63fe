"""Where records come from and where they go: Spark's own readers and writers, with contracts between."""

from .quarantine import read_documents, split

__all__ = ["read_documents", "split"]
