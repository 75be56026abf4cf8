"""Zip packages with the guards that untrusted files need."""

from __future__ import annotations

import io
import posixpath
import zipfile

MAX_ENTRIES = 65_535
MAX_RATIO = 1024
MAX_TOTAL = 2 << 30


class PackageError(ValueError):
    pass


def open_package(data: bytes, only: set[str] | None = None) -> dict[str, bytes]:
    """name -> content, of all entries or some. Unsafe names, encryption, too many entries and bombs are refused."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise PackageError(str(e)) from e
    entries = archive.infolist()
    if len(entries) > MAX_ENTRIES:
        raise PackageError("too many entries")
    if sum(e.file_size for e in entries) > MAX_TOTAL:
        raise PackageError("expands too far")
    out = {}
    for e in entries:
        name = e.filename
        if name.startswith("/") or "\\" in name or ".." in name.split("/"):
            raise PackageError(f"unsafe name {name!r}")
        if e.flag_bits & 1:
            raise PackageError(f"{name} is encrypted")
        if e.file_size > max(1 << 20, e.compress_size * MAX_RATIO):
            raise PackageError(f"{name} expands too far")
        if not e.is_dir() and (only is None or name in only):
            try:
                out[name] = archive.read(e)
            except (zipfile.BadZipFile, EOFError, OSError, ValueError) as x:
                raise PackageError(f"{name}: {x}") from x
    return out


def resolve(base: str, target: str) -> str:
    """A relationship target against the part that names it; never above the root."""
    path = posixpath.normpath(target if target.startswith("/") else posixpath.join("/", posixpath.dirname(base), target))
    return path.lstrip("/")


def decode(data: bytes) -> str:
    """UTF-8, or UTF-16 by its byte order mark."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    return data.decode("utf-8-sig")
