"""Training-data operators: dedup, decontamination, quality, mixing, sharding, scoring.

Nothing else in the package imports this subpackage.
"""
