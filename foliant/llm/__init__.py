"""Training-data operators: archives, fingerprints, duplicates, mixing, tokens, language.

Nothing outside this subpackage imports it.
"""
