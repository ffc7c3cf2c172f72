"""Keyed N-dimensional arrays, dependence-aware parallel loops and corpus tools on Spark."""
