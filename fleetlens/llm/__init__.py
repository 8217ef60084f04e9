"""Operators for preparing training corpora: fingerprints, joins, filters, sharding, token files, mixing, packing."""
