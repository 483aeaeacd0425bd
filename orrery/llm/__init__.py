"""Training-data operators: scoring, decontamination, archives, deduplication, tokenising, classifying, search, sharding.

Nothing outside this subpackage imports it.
"""
