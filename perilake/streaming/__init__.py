"""Incremental refresh of the layered tables from arriving files."""
