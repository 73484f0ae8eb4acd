"""Operators of a training-data pipeline (toxicity, deduplication, decontamination, PII, ...).

Nothing outside this subpackage imports it; its queries are listed in ``registry.py``.
"""
