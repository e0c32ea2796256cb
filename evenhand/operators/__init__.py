"""Operators: metrics, weights, relabelling, repair, oversampling, masking, mapping."""
