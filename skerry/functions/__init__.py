"""Skerry functions."""
