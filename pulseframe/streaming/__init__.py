"""Operators over live sample streams."""
