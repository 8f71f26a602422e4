"""Operators for preparing training text at scale: scoring, de-duplication, counting, mixing, archives."""
