"""Tidemill: batch, warehouse and streaming table jobs on Spark DataFrames."""

from tidemill.session import build_session

__all__ = ["build_session"]
