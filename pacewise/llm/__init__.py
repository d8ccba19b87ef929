"""Operators of a training-data pipeline: near duplicates, token counts, filters, mixing, archives."""
