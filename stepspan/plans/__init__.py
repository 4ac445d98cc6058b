"""Queries on the driver's tables."""

from . import access_queries, feed_queries, journey_queries, source_queries, stream_queries, text_queries, timetable_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "access_queries", "feed_queries", "journey_queries", "source_queries", "stream_queries", "text_queries", "timetable_queries"]
