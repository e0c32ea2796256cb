"""Pipelines, cross-validation and the registered queries."""
