"""Incremental landing of yearly files."""
