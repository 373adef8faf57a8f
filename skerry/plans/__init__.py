"""Skerry plans."""
