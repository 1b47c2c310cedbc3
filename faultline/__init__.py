"""Incident analytics as PySpark DataFrame operators."""

from faultline.session import configure

__all__ = ["configure"]
