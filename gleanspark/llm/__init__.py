"""Operators for training data: quality, near duplicates, personal data, tokens, packing, search and language.

Nothing outside this subpackage imports it. ``queries`` registers one query per operator.
"""
