"""Operators for preparing training data: one module each, with queries in ``queries``."""
