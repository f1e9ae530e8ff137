"""Readers of snapshots and stored tables as fact tables."""
