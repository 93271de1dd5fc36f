"""Operators for preparing text corpora: language mixtures, deduplication, decontamination, token files, media
columns, page extraction, URL rules, quality scores, personal data and subword transducers.

Nothing else in the library imports this subpackage.
"""
