"""Skerry streaming."""
