"""Column functions: keyed uniform draws and distributed ranks."""
