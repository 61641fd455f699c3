"""Name-based identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of name-based identifiers (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
CONCEPT_PREFIX = "concept:"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID of a text in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, 1)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def concept_id(label: Column, prefix: str = CONCEPT_PREFIX) -> Column:
    """Identifier of the concept of a label; the same label always has the same one."""
    return uuid5(F.concat(F.lit(prefix), label))
