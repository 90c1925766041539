"""Facts about file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col

# fixed values: leading bytes (hex) of file formats, at the offset (bytes) given, and their content types
SIGNATURES = [
    (0, "FFD8FF", "image/jpeg"),
    (0, "89504E470D0A1A0A", "image/png"),
    (0, "474946383761", "image/gif"),
    (0, "474946383961", "image/gif"),
    (8, "57454250", "image/webp"),
    (4, "6674797061766966", "image/avif"),
    (4, "6674797068656963", "image/heic"),
    (0, "424D", "image/bmp"),
    (0, "3C737667", "image/svg+xml"),
    (0, "255044462D", "application/pdf"),
]
UNKNOWN_TYPE = "application/octet-stream"


def content_type(content) -> Column:
    """Content type by the leading bytes; the name of the file plays no part."""
    head = F.hex(F.substring(col(content), 1, 16))
    out = F.lit(UNKNOWN_TYPE)
    for offset, signature, kind in reversed(SIGNATURES):
        found = F.substring(head, 2 * offset + 1, len(signature)) == signature
        if kind == "image/webp":  # a RIFF container by its first four bytes
            found = found & head.startswith("52494646")
        out = F.when(found, kind).otherwise(out)
    return F.when(col(content).isNotNull(), out)
