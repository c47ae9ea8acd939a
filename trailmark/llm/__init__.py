"""Training-data operators: packing, tokens, classifiers, deduplication, rules and token files."""
