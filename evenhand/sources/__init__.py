"""Readers of the classic fairness datasets."""
