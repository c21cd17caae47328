"""Operators for preparing large text corpora: near and exact dedup, decontamination,
mixing, sharding, quality rules and classification, language identification, token
counts, filter audits and vector codes.

Nothing outside this subpackage imports it.
"""
