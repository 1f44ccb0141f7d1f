"""Entropy, fingerprints and markers of secret values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "spoolsift"


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(value, "")
    size = F.length(value)

    def add(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(value, char, F.lit("")))) / size
        return total - share * F.log2(share)

    return F.when(size > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), add)).otherwise(0.0)


def fingerprint(value: Column, salt: str) -> Column:
    """First 8 hex digits of the salted hash: the same secret gives the same tag, the tag gives no secret."""
    return F.left(F.sha2(F.concat(F.lit(salt), value), 256), F.lit(8))


def marker(kind: Column, value: Column, salt: str) -> Column:
    """What stands in the text instead of the value."""
    return F.concat(F.lit(f"[{TAG}:redacted:"), kind, F.lit(":"), fingerprint(value, salt), F.lit("]"))
