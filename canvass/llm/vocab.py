"""Vocabulary files of public tokenizers, read on the driver and sent to executors.

Their size is that of the file (a few MB at most: a proven bound), so they may be broadcast.
"""

from __future__ import annotations

import base64
import json


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks from a rank file: a base64 token and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
