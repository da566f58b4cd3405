"""Evidence about tabular data at cluster scale, on Spark DataFrames."""

from .api import detect_leakage, diff, fingerprint, generate_keypair, profile, scan_pii, sign_receipt, validate, verify_receipt

__all__ = ["detect_leakage", "diff", "fingerprint", "generate_keypair", "profile", "scan_pii", "sign_receipt", "validate", "verify_receipt"]
