"""Redaction of log fields and classes of failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that never appear in logs.
SECRET_FIELDS = ("rawText", "decryptionKey", "encryptionKey", "decryptionNonce", "key", "nonce", "plaintext", "ciphertext", "payload", "thoughtforms", "entities", "relationships", "contextGraph")
#: What an exit code means and what to do about it.
FAILURES = {
    2: ("ERR_VALIDATION", "Check input file format and ThoughtForm schema compliance. Run with --dry-run to preview."),
    3: ("ERR_AUTH", "Verify principal identity and canister allowlist. Re-authenticate with dfx identity."),
    4: ("ERR_NETWORK", "Check network connectivity and canister availability. Retry the operation."),
    5: ("ERR_INTEGRITY", "Data integrity check failed. Verify chunk hashes and encryption keys. Consider a full restore."),
}
OTHER_FAILURE = ("ERR_UNKNOWN", "Unexpected error. Check logs for details and retry.")


def redact(fields: Column) -> Column:
    """A map with the values of secret top-level keys replaced."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*SECRET_FIELDS), F.lit("[REDACTED]")).otherwise(v))


def classify(exit_code: Column) -> Column:
    """struct(code, remediation)."""
    make = lambda p: F.struct(F.lit(p[0]).alias("code"), F.lit(p[1]).alias("remediation"))
    out = None
    for code, pair in FAILURES.items():
        out = F.when(exit_code == code, make(pair)) if out is None else out.when(exit_code == code, make(pair))
    return out.otherwise(make(OTHER_FAILURE))
