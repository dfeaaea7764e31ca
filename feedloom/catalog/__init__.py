"""Registered queries: every operator over tables derived from the given ones."""

from feedloom.catalog.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
