"""Training-data operators: licences, personal data, mixing, near-duplicates, pages, media, tokens, quality, language.

Nothing outside this subpackage imports it.
"""
