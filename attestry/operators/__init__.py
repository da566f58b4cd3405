"""Profiles, fingerprints, validation, differences, leakage and personal data."""
