"""A document, relationship and search engine whose only executor is Spark."""

from brindle.catalog import Bucket, Workspace
from brindle.session import build_session

__all__ = ["Bucket", "Workspace", "build_session"]
