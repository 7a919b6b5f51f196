"""Readers of tables and layers."""
