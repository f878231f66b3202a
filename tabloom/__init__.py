"""tabloom: record analytics on Spark DataFrames."""

from tabloom.session import build_session, cut_lineage

__all__ = ["build_session", "cut_lineage"]
