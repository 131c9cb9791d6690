"""Training-data operators: scoring, language, packing, joins, dedup, tokenizers, media, HTML, secrets, fingerprints.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
