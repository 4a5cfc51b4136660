"""Tensors of length-prefixed files as a data source: counts of values, in many tasks.

A file begins with the length of its header (eight bytes) and the header, a JSON object that has dtype, shape and byte offsets of each
tensor. The driver reads headers alone; it plans ranges of elements, and each task reads the bytes of its range and counts
them. A large tensor is many ranges, many small ones are one task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import SourceError

#: Bytes of an element by dtype (fixed values).
SIZES = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}
_NUMPY = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1"}
#: Bytes of a task's range, and of a header at most.
PART, HEADER = 64 << 20, 100 << 20
SCHEMA = "file string, name string, dtype string, shape array<long>, count long, non_finite long, non_zero long, least double, most double, squares double"


@dataclass
class Range(InputPartition):
    """Parts of tensors that a task reads: (name, dtype, shape, first byte, bytes)."""

    file: str
    parts: tuple


def _opened(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return system, path


def _files(uri: str) -> list[str]:
    from pyarrow import fs

    system, path = _opened(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
        return sorted(head + f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".safetensors"))
    return [uri]


def header(uri: str) -> tuple[dict, int, int]:
    """Tensors of a file, where their bytes begin, and its size; an error where they do not fit one another."""
    system, path = _opened(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        length = int.from_bytes(f.read(8), "little")
        if size < 8 or not 2 <= length <= min(HEADER, size - 8):
            raise SourceError(f"{uri}: no header")
        try:
            found = json.loads(f.read(length))
        except ValueError as e:
            raise SourceError(f"{uri}: header is no JSON") from e
    found.pop("__metadata__", None)
    begin, at = 8 + length, 0
    for name, t in sorted(found.items(), key=lambda x: x[1]["data_offsets"]):
        first, end = t["data_offsets"]
        if t["dtype"] not in SIZES:
            raise SourceError(f"{uri}: {name} has dtype {t['dtype']}")
        if first != at or end - first != math.prod(t["shape"]) * SIZES[t["dtype"]] or begin + end > size:
            raise SourceError(f"{uri}: bytes of {name} do not fit its shape or the file")
        at = end
    return found, begin, size


def planned(uri: str, part: int) -> list[Range]:
    """Ranges of about ``part`` bytes; none without a tensor, an empty tensor has a part of no bytes."""
    found, begin, _ = header(uri)
    out, own, size = [], [], 0
    for name, t in sorted(found.items(), key=lambda x: x[1]["data_offsets"]):
        first, end = t["data_offsets"]
        step = max(1, part // SIZES[t["dtype"]]) * SIZES[t["dtype"]]
        for at in range(first, end, step) if end > first else [first]:
            n = min(step, end - at)
            if own and size + n > part:
                out.append(Range(uri, tuple(own)))
                own, size = [], 0
            own.append((name, t["dtype"], tuple(t["shape"]), begin + at, n))
            size += n
    return [*out, Range(uri, tuple(own))] if own else out


def counted(raw: bytes, dtype: str) -> tuple:
    """count, non_finite, non_zero, least, most and sum of squares of the finite values."""
    import numpy as np

    x = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32) if dtype == "BF16" else np.frombuffer(raw, _NUMPY[dtype])
    finite = np.isfinite(x)
    own = x[finite].astype(np.float64)
    return len(x), int(len(x) - finite.sum()), int(np.count_nonzero(x)), *((float(own.min()), float(own.max())) if len(own) else (None, None)), float(np.square(own).sum())


class _Reader(DataSourceReader):
    def __init__(self, uri: str, part: int):
        self.uri, self.part = uri, part

    def partitions(self) -> list[Range]:
        return [r for f in _files(self.uri) for r in planned(f, self.part)] or [Range("", ())]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.parts:
            return
        system, path = _opened(partition.file)
        with system.open_input_file(path) as f:
            for name, dtype, shape, at, n in partition.parts:
                f.seek(at)
                raw = f.read(n)
                if len(raw) != n:
                    raise SourceError(f"{partition.file}: ends within {name}")
                yield (partition.file, name, dtype, list(shape), *counted(raw, dtype))


class Tensors(DataSource):
    """``spark.read.format("tensors").option("part", bytes).load(file or folder)``: a row for each range of a tensor."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("part", PART)))


def tensor_table(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """A row for each tensor below a path: values, those that are no finite numbers or not zero, range and norm of the finite ones."""
    spark.dataSource.register(Tensors)
    rows = spark.read.format("tensors").option("part", part).load(path)
    return rows.groupBy("file", "name", "dtype", "shape").agg(
        *(F.sum(c).alias(c) for c in ("count", "non_finite", "non_zero")), F.min("least").alias("least"), F.max("most").alias("most"), F.sqrt(F.sum("squares")).alias("norm")
    )


def adapter_summary(tensors: DataFrame, down: str = ".lora_A.", up: str = ".lora_B.") -> DataFrame:
    """For each file: adapter tensors, those of the second factor that are not all zero, and PASS if all are finite and there is a second factor.

    Values that never moved from zero leave the model as it was: ``learned`` says whether any did.
    """
    own: Column = F.contains("name", F.lit(down)) | F.contains("name", F.lit(up))
    second = F.contains("name", F.lit(up))
    out = tensors.where(own).groupBy("file").agg(
        F.count("*").alias("tensors"), F.count_if(second).alias("second"), F.count_if(second & (F.col("non_zero") > 0)).alias("nonzero_second"), F.sum("non_finite").alias("non_finite"), F.sum("count").alias("values")
    )
    return out.withColumns({"learned": F.col("nonzero_second") > 0, "status": F.when((F.col("non_finite") == 0) & (F.col("second") > 0), "PASS").otherwise("FAIL")})
