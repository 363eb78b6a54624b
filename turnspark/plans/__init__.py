"""Whole workflows composed of the operators."""
