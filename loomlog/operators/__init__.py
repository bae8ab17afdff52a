"""Batch operators: reads, appends, confirmation, and the data-processing operators."""
