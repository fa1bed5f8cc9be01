"""Functions on columns: the strict JSON codec."""
