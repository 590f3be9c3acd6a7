"""Attachments fetched into a folder that all executors share: allowed formats only, bounded in size, checked and renamed last."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Formats that are fetched (fixed values), and the size in MB beyond which a file is left out.
FORMATS, MAX_MB = ("pdf", "doc", "docx", "txt", "html"), 25
#: From an address to the length it announces (None if it doesn't) and its bytes in pieces.
Opener = Callable[[str], tuple[int | None, Iterable[bytes]]]


class TooLarge(ValueError):
    """More bytes than a file may have."""


def safe_name(name: str) -> str:
    return re.sub(r"[^\w-]", "", name)


def _hashed(path: str) -> tuple[str, int]:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest(), os.path.getsize(path)


def download(url: str, path: str, opener: Opener, max_bytes: int) -> tuple[str, int]:
    """Fetch a file: checksum and size. It gets its name only when it is whole; of two tasks that fetch it one wins."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        length, pieces = opener(url)
        if length is not None and length > max_bytes:
            raise TooLarge(f"{length} bytes are announced and {max_bytes} allowed")
        size, digest = 0, hashlib.sha256()
        with open(part, "wb") as f:
            for piece in pieces:
                size += len(piece)
                if size > max_bytes:
                    raise ValueError(f"over {max_bytes} bytes came")
                f.write(piece)
                digest.update(piece)
        if length is not None and size != length:
            raise ValueError(f"{size} of {length} bytes came")
        os.replace(part, path)
        return digest.hexdigest(), size
    finally:
        if os.path.exists(part):
            os.unlink(part)


def fetch_attachments(files: DataFrame, folder: str, opener: Opener, max_mb: int = MAX_MB, force: bool = False) -> DataFrame:
    """``attachment_id, comment_id, docket_id, local_path, download_status, download_error, checksum_sha256, size_bytes_actual``.

    ``files`` has ``attachment_id, comment_id, docket_id, file_url, format``. Formats beside ``FORMATS`` and files announced as too
    large are ``skipped``; those without an address or with an error on the way are ``failed``, and the others go on. A file that is
    there already is hashed instead of fetched, unless ``force``. ``folder`` must be mounted on all executors.
    """
    def one(row: dict) -> tuple:
        kind = (row["format"] or "").lower().strip()
        if kind not in FORMATS:
            return None, "skipped", f"format {kind!r} is not allowed", None, None
        if not row["file_url"]:
            return None, "failed", "no address", None, None
        place = os.path.join(folder, *(safe_name(row[c] or "") or "_" for c in ("docket_id", "comment_id")))
        path = os.path.join(place, f"{safe_name(row['attachment_id'] or '') or '_'}.{kind}")
        try:
            os.makedirs(place, exist_ok=True)
            found = _hashed(path) if os.path.exists(path) and not force else download(row["file_url"], path, opener, max_mb << 20)
            return path, "downloaded", None, *found
        except TooLarge as e:
            return None, "skipped", str(e), None, None
        except Exception as e:  # noqa: BLE001  whatever went wrong belongs to this file alone
            return None, "failed", f"{type(e).__name__}: {e}", None, None

    names = ("local_path", "download_status", "download_error", "checksum_sha256", "size_bytes_actual")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [one(row) for row in x.to_dict("records")]
            out = x[["attachment_id", "comment_id", "docket_id"]].assign(**{c: [f[i] for f in found] for i, c in enumerate(names)})
            yield out.astype({"size_bytes_actual": "Int64"})

    columns = files.select("attachment_id", "comment_id", "docket_id", "file_url", "format")
    return columns.mapInPandas(run, "attachment_id string, comment_id string, docket_id string, local_path string, download_status string, download_error string, checksum_sha256 string, size_bytes_actual long")
