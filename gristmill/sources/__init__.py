"""Readers for the tables that queries run on."""

from gristmill.sources.tables import read_table

__all__ = ["read_table"]
