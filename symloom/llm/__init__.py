"""Training-data operators: scoring, media, joins, packing, privacy, language, dedup and tokens.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where it can be imported.
"""
