"""Downloads of zipped domain lists, on the driver."""

from __future__ import annotations

import enum
import os
import shutil
import urllib.request
import zipfile

from ..config import Config


class ListKind(enum.Enum):
    FULL = "full"
    DAILY_UPDATE = "dailyupdate"
    DAILY_REMOVE = "dailyremove"


class DownloadError(RuntimeError):
    pass


def list_url(config: Config, kind: ListKind) -> str:
    config.need("zone_url", "zone_token")
    return f"{config.zone_url.rstrip('/')}/{config.zone_token}/get/{kind.value}/list/zip"


def member_of(names: list[str]) -> str:
    """domains.txt, at the top or in a folder, or else the first text file."""
    best = next((n for n in names if n == "domains.txt" or n.endswith("/domains.txt")), None)
    best = best or next((n for n in names if n.endswith(".txt")), None)
    if best is None:
        raise DownloadError("the archive has no text file")
    return best


def extract(archive: str, target: str) -> str:
    with zipfile.ZipFile(archive) as z, z.open(member_of(z.namelist())) as source, open(target, "wb") as out:
        shutil.copyfileobj(source, out, 1 << 20)
    return target


def download_bytes(config: Config, kind: ListKind) -> bytes:
    """The archive as it comes, in memory, for lists known to be small."""
    try:
        with urllib.request.urlopen(list_url(config, kind), timeout=3600) as response:
            return response.read()
    except OSError as e:
        raise DownloadError(str(e)) from e


def download(config: Config, kind: ListKind) -> str:
    """The path of the extracted list; the archive is removed."""
    os.makedirs(config.download_dir, exist_ok=True)
    archive, target = (os.path.join(config.download_dir, f"{kind.value}.{end}") for end in ("zip", "txt"))
    try:
        with urllib.request.urlopen(list_url(config, kind), timeout=3600) as response, open(archive, "wb") as out:
            shutil.copyfileobj(response, out, 1 << 20)
    except OSError as e:
        raise DownloadError(str(e)) from e
    extract(archive, target)
    os.remove(archive)
    return target
