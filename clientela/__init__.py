"""Customer analytics on Spark DataFrames."""

from clientela.session import build_session, settle

__all__ = ["build_session", "settle"]
