"""Settings, from arguments or the environment. Credentials are asked for only by what uses them."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    pass


def dot_env(path: str) -> dict[str, str]:
    """NAME=value lines; quotes around values and a leading ``export`` go, comments and other lines are passed over."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = [re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line) for line in f]
    plain = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else re.sub(r"\s+#.*$", "", v)
    return {m[1]: plain(m[2]) for m in found if m}


@dataclass(frozen=True)
class Config:
    index_path: str = "./data/index"
    segmenter_url: str = ""
    segmenter_user: str = ""
    segmenter_password: str = ""
    zone_url: str = ""
    zone_token: str = ""
    download_dir: str = "./data/downloads"
    batch_size: int = 50_000
    cache_entries: int = 10_000
    cache_ttl: int = 86_400

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "NAMELODE_", file: str = ".env") -> Config:
        """From env, by default the environment and, for what it does not set, a file of NAME=value lines."""
        env = {**dot_env(file), **os.environ} if env is None else env
        values = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                try:
                    values[f.name] = type(f.default)(raw)
                except ValueError as e:
                    raise ConfigError(f"{prefix}{f.name.upper()}: {raw!r}") from e
        return cls(**values)

    def need(self, *names: str) -> None:
        missing = [n for n in names if not getattr(self, n)]
        if missing:
            raise ConfigError(f"not set: {', '.join(missing)}")
