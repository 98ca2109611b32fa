"""Operators for text and entity corpora: tokens, source mixing, personal details, record and name linkage.

Nothing outside this subpackage imports it.
"""
