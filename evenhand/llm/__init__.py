"""Training-data operators: dedup, decontamination, mixing, sharding, token and archive output.

Nothing outside this folder imports it; it can be deleted without breaking the rest.
"""
