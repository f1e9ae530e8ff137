"""Append-only event logs."""
