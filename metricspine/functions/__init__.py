"""Expressions of metrics, and exact order statistics."""
