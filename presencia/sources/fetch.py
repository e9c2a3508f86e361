"""Files from the network onto a local or mounted folder, on the driver."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterable
from urllib.request import urlopen


def fetch(files: Iterable[tuple[str, str, str]], force: bool = False, open_url: Callable = urlopen) -> list[str]:
    """Fetch (id, url, path) files; ids of those that failed, once per file.

    Existing files are kept unless ``force``.  A file appears whole or not at all.
    """
    failed = []
    for name, url, path in files:
        if os.path.exists(path) and not force:
            continue
        part = f"{path}.part"
        try:
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            with open_url(url) as source, open(part, "wb") as target:
                shutil.copyfileobj(source, target)
            os.replace(part, path)
        except OSError:
            failed.append(name)
            if os.path.exists(part):
                os.remove(part)
    return failed


def genome_files(ids: Iterable[str], template: str, folder: str, kinds: Iterable[str] = ("fna", "gff")) -> list[tuple[str, str, str]]:
    """(id, url, path) of each genome's files; the template takes ``{id}`` and ``{kind}``."""
    kinds = list(kinds)
    return [(i, template.format(id=i, kind=k), os.path.join(folder, k, f"{i}.{k}")) for i in ids for k in kinds]
