"""Operators for building training data: deduplication, decontamination, filtering, mixing, sharding and scoring."""
