"""Spark-native extraction, validation, scoring and evaluation of tax-document corpora."""

from formwright.plans.documents import DocumentEngine
from formwright.session import build_session

__all__ = ["DocumentEngine", "build_session"]
