"""Operators for preparing training text at scale.

Self-contained: nothing outside this folder imports it.
"""
