"""Frames along a walk, and aggregation over them."""
