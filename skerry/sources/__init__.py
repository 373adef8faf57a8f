"""Skerry sources."""
