"""String expressions that follow Python's text rules rather than SQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() knows it: Unicode white space and U+001C to U+001F.
_SPACE = r"[\s\x{1c}-\x{1f}]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """All white space off both ends; null stays null."""
    return F.btrim(col(c), F.lit(SPACES))


def clean(c: Column | str) -> Column:
    """Stripped text; null, empty and blank all become the empty string."""
    return F.coalesce(strip(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return clean(c) == ""


def squeeze(c: Column | str) -> Column:
    """Words joined by single spaces, in lower case (the key by which options are compared)."""
    words = F.regexp_replace(clean(c), f"(?U){_SPACE}+", " ")
    return F.lower(words)


def kilo(seconds: Column | str) -> Column:
    """Seconds to milliseconds."""
    return col(seconds) * 1000.0


def mebi(n_bytes: Column | str) -> Column:
    """Bytes to MiB."""
    return col(n_bytes) / float(1 << 20)


def data_uri(content: Column | str, kind: Column | str = "image/png") -> Column:
    """Bytes as a data URI of a media type (re-encoding is left to whoever has the pixels)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.replace(F.base64(F.col(content) if isinstance(content, str) else content), F.lit("\r\n"), F.lit("")))
