"""Approximate indexes: inverted lists, product quantization with an optional rotation, navigable small-world graphs."""

from .hnsw import HnswIndex
from .ivf import IvfIndex
from .pq import IvfPqIndex

__all__ = ["HnswIndex", "IvfIndex", "IvfPqIndex"]
