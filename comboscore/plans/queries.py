"""Importing this module registers every query (see ``registry.REGISTRY``)."""

from comboscore.plans import q_eval, q_misc, q_pairs, q_text  # noqa: F401
