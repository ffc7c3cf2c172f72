"""Operators on arrays and the runners of parallel loops."""
