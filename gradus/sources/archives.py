"""ZIP archives: their entry table, verified contents, and a writer of fixed bytes."""

from __future__ import annotations

import hashlib
import io
import json
import pathlib
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.validation import MAX_ARCHIVE_BYTES, MAX_ENTRIES, MAX_EXPANDED_BYTES, MAX_MEMBER_BYTES, MAX_RATIO
from .files import SourceError

_ENTRIES = "archive string, name string, file_size long, compress_size long, compress_type int, flag_bits int, external_attr long, is_dir boolean, sha256 string"


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, content in zip(f["path"], f["content"], strict=True):
            rows = []
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    digest = None
                    if i.file_size <= MAX_MEMBER_BYTES and not i.flag_bits & 1:
                        with z.open(i) as member:
                            raw = member.read(MAX_MEMBER_BYTES + 1)
                        digest = hashlib.sha256(raw).hexdigest() if len(raw) == i.file_size else None
                    rows.append((path, i.filename, i.file_size, i.compress_size, i.compress_type, i.flag_bits, i.external_attr, i.is_dir(), digest))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ENTRIES.split(", ")])


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of each archive, with the SHA-256 of members within the size budget."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_listed, _ENTRIES)


def _plain(name: str) -> bool:
    parts = name.split("/")
    return bool(name) and not {"", ".", ".."} & set(parts) and not any(c in name for c in "\\:") and min(map(ord, name)) > 31


def members(raw: bytes, marker: str) -> tuple[dict, dict[str, bytes]]:
    """Manifest and files of an archive that keeps every budget and holds just what its manifest lists; else an error.

    Sizes are checked as declared before anything is read, and no member is read beyond its own.
    """
    if len(raw) > MAX_ARCHIVE_BYTES:
        raise SourceError("archive over budget")
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        names = [i.filename for i in infos]
        if not 1 <= len(infos) <= MAX_ENTRIES or len({n.lower() for n in names}) != len(names) or not all(map(_plain, names)):
            raise SourceError("too many, unsafe or colliding entries")
        if sum(i.file_size for i in infos) > MAX_EXPANDED_BYTES:
            raise SourceError("expanded size over budget")
        found = {}
        for i in infos:
            if i.is_dir() or i.flag_bits & 1 or (i.external_attr >> 16) & 0o170000 not in (0, 0o100000) or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise SourceError(f"{i.filename}: not a plain file")
            if i.file_size > MAX_MEMBER_BYTES or i.file_size > MAX_RATIO * i.compress_size:
                raise SourceError(f"{i.filename}: size over budget")
            with z.open(i) as member:
                found[i.filename] = member.read(i.file_size + 1)
            if len(found[i.filename]) != i.file_size:
                raise SourceError(f"{i.filename}: another size than declared")
    if marker not in found:
        raise SourceError("no manifest")
    manifest = json.loads(found.pop(marker))
    listed = {e["path"]: (e["bytes"], e["sha256"]) for e in manifest["files"]}
    if len(listed) != len(manifest["files"]) or listed != {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in found.items()}:
        raise SourceError("files and manifest differ")
    return manifest, found


def extract_archive(path: str, destination: str, marker: str) -> dict:
    """Write the files of a verified archive into a new folder, check them there, then put it in place; returns the manifest."""
    with open(path, "rb") as f:
        manifest, found = members(f.read(MAX_ARCHIVE_BYTES + 1), marker)
    target = pathlib.Path(destination)
    if target.exists():
        raise SourceError(f"{destination}: is there already")
    with tempfile.TemporaryDirectory(dir=target.parent) as work:
        for name, raw in found.items():
            out = pathlib.Path(work, "files", name)
            out.parent.mkdir(parents=True, exist_ok=True)
            out.write_bytes(raw)
        for e in manifest["files"]:
            if hashlib.sha256(pathlib.Path(work, "files", e["path"]).read_bytes()).hexdigest() != e["sha256"]:
                raise SourceError(f"{e['path']}: written otherwise than read")
        pathlib.Path(work, "files").rename(target)
    return manifest


def write_archive(path: str, files: dict[str, bytes], marker: str, identity: dict, allowed: tuple[str, ...] = ("",)) -> str:
    """A ZIP of small files and a manifest of them; equal input gives equal bytes. Returns the manifest's hash.

    Only files below one of the ``allowed`` prefixes may go in, and the archive is read back and verified
    before it is published.
    """
    odd = sorted(n for n in files if not _plain(n) or n == marker or not n.startswith(allowed))
    if odd:
        raise SourceError(f"files that may not be published: {odd[:10]}")
    entries = [{"path": n, "bytes": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, b in sorted(files.items())]
    manifest = json.dumps({**identity, "files": entries}, sort_keys=True, indent=1).encode()
    from .sinks import atomic_write

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in [(marker, manifest), *sorted(files.items())]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o100644 << 16
            z.writestr(info, raw)
    if members(out.getvalue(), marker)[1] != files:
        raise SourceError("the archive does not hold what it was made of")
    atomic_write(path, out.getvalue())
    return hashlib.sha256(manifest).hexdigest()
