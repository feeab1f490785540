"""Training-data operators: toxicity, near and exact duplicates, decontamination, mixing, tokens, quality, sharding, URLs.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
