"""Listing and opening files on a path every node can see (a mounted or shared folder)."""

from __future__ import annotations

import os


def list_files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files under ``path`` (or the file itself) by name order."""
    path = path.removeprefix("file://")
    if os.path.isfile(path):
        return [path]
    found = []
    for folder, _, names in os.walk(path):
        found += [os.path.join(folder, n) for n in names if n.lower().endswith(suffixes)]
    return sorted(found)


def open_file(path: str):
    return open(path, "rb")
