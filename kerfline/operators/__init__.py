"""Relational operators: alignment, fusion, metrics, windows, segmentation, selection, splits and ledgers."""
