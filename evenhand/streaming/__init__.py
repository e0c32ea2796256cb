"""Structured Streaming monitor."""
