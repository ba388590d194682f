"""Filters, comparisons, block deltas, reports and side-effect jobs."""
