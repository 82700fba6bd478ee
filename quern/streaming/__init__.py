"""Span logs as streams."""
