"""Streaming forms of sessions and windows."""
