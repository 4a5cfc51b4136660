"""Content fingerprints: SHA-256 of JSON with sorted keys and no spaces."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fingerprint(*columns: str) -> Column:
    """Fingerprint of a flat record of strings, integers, booleans, nulls and arrays of strings.

    Built of JVM expressions; records with floating-point numbers or maps take `fingerprint_any`,
    as the JVM writes floats differently.
    """
    record = F.struct(*(F.col(c) for c in sorted(columns)))
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}).cast("binary"), 256)


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if hasattr(x, "tolist"):
        return _plain(x.tolist())
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return None if x is pd.NA else x


@F.pandas_udf(T.StringType())
def fingerprint_any(records: pd.DataFrame) -> pd.Series:
    """Fingerprint of a struct column with any fields."""
    rows = records.astype(object).where(records.notna(), None).to_dict("records")
    return pd.Series([hashlib.sha256(canonical_json(_plain(r)).encode()).hexdigest() for r in rows])
