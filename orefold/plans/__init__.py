"""Compositions: relevance, change propagation and staging."""
