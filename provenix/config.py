"""Settings: defaults, a JSON file with profiles, and overrides; the later wins."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

#: Hash algorithms that there are.
ALGORITHMS = ("sha256", "sha512")
ENV = "PROVENIX_CONFIG"


class ConfigError(Exception):
    """The settings can't be used; the message says why."""


@dataclass(frozen=True)
class Limits:
    """Settings of an analysis; 0 turns the size check off, and 0 jobs are as many as Spark sees fit."""

    hash_algorithms: tuple[str, ...] = ("sha256",)
    max_file_size_bytes: int = 512 << 20
    exif_max_tags: int = 512
    exif_max_value_bytes: int = 1 << 20
    xmp_max_packet_bytes: int = 4 << 20
    icc_max_profile_bytes: int = 4 << 20
    identify_header_bytes: int = 65_536
    batch_jobs: int = 0


@dataclass(frozen=True)
class Config:
    limits: Limits
    profile: str = "default"
    source: str = "defaults"

    def shown(self) -> dict:
        return {"profile": self.profile, "source": self.source, **asdict(self.limits), "hash_algorithms": list(self.limits.hash_algorithms)}


def checked(values: object, where: str) -> dict:
    """The settings of an object; unknown names, wrong types and unknown algorithms are errors."""
    if not isinstance(values, Mapping):
        raise ConfigError(f"{where}: settings must be an object")
    names = {f.name for f in fields(Limits)}
    if unknown := sorted(set(values) - names):
        raise ConfigError(f"{where}: unknown settings {', '.join(unknown)}; there are {', '.join(sorted(names))}")
    out = dict(values)
    for name, value in out.items():
        if name != "hash_algorithms" and (not isinstance(value, int) or isinstance(value, bool) or value < 0):
            raise ConfigError(f"{where}: {name} must be a number from 0 on")
    if "hash_algorithms" in out:
        given = out["hash_algorithms"]
        if not isinstance(given, list | tuple) or not given:
            raise ConfigError(f"{where}: hash_algorithms must be a list that isn't empty")
        if unknown := [x for x in given if x not in ALGORITHMS]:
            raise ConfigError(f"{where}: unknown hash algorithms {', '.join(map(str, unknown))}; there are {', '.join(ALGORITHMS)}")
        out["hash_algorithms"] = tuple(dict.fromkeys(("sha256", *given)))  # sha256 is always there
    return out


def load(path: str | Path | None = None, profile: str = "default", overrides: Mapping | None = None) -> Config:
    """Settings of a file (or the one that the environment names), of its profile if it has profiles, and overrides. A file that isn't there leaves the defaults."""
    place = path or os.environ.get(ENV)
    limits, source = Limits(), "defaults"
    if place and Path(place).exists():
        try:
            found = json.loads(Path(place).read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise ConfigError(f"{place} can't be read: {e}") from e
        where = str(place)
        if isinstance(found, dict) and "profiles" in found:
            profiles = found["profiles"]
            if not isinstance(profiles, dict):
                raise ConfigError(f"{place}: profiles must be an object")
            if profile not in profiles:
                raise ConfigError(f"{place}: no profile {profile!r}; there are {', '.join(sorted(profiles)) or 'none'}")
            found, where = profiles[profile], f"{place}, profile {profile}"
        limits, source = replace(limits, **checked(found, where)), str(place)
    if overrides:
        limits = replace(limits, **checked(overrides, "overrides"))
    return Config(limits, profile, source)
