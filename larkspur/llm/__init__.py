"""Training-data operators: classification, deduplication, archives, rules, language models, mixing, tokenising.

Nothing outside this subpackage imports it.
"""
