"""Skerry operators."""
