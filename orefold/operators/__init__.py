"""Joins, rollups, rankings, graph queries and set operations over fact tables."""
