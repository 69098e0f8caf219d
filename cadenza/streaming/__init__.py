"""Streaming forms of the timeline operators."""
