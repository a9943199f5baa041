"""Operators of a training-data pipeline: packing, sharding, mixing, near duplicates, toxicity, fingerprints, rules, archives."""
