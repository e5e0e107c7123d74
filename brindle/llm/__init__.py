"""Operators for large text corpora: de-duplication, decontamination,
classification, formatting, packing and sharding.

Nothing else in the library imports this subpackage; it is self-contained.
"""
