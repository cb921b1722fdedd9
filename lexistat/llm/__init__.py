"""Operators of a training-data pipeline: filtering, deduplication, decontamination, formatting, packing, output."""
