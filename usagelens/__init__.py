"""usagelens: usage analytics over request logs, written as Spark DataFrame jobs."""

from usagelens.session import configure

__all__ = ["configure"]
