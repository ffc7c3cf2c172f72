"""Iterative programs built from the operators."""
