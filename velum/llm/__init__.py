"""Operators for preparing training data: deduplication, decontamination, filters,
mixing, sharding and token files. Nothing else in the package imports this."""
