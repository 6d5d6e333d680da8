"""A PySpark engine that screens, scores, de-duplicates and reports job postings."""

from .profile import SearchProfile

__all__ = ["SearchProfile"]
