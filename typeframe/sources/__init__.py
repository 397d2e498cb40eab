"""Readers and writers of tagged datasets."""

from .files import read, write
from .social import community_xml, interactions

__all__ = ["community_xml", "interactions", "read", "write"]
