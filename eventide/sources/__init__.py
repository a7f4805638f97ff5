"""Readers, writers and pluggable data sources."""
