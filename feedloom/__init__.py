"""Feed, article and directory analytics as Spark DataFrame and streaming jobs."""

from feedloom.session import build_session, configure

__all__ = ["build_session", "configure"]
