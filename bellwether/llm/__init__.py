"""Operators of a training-data pipeline: near copies, lines, quality, toxicity,
language, mixing, repeated passages, packing, token files and exact search."""
