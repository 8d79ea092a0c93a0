"""Settings from untrusted data: every field falls back on its own."""

from __future__ import annotations

import json
import math
import os
import re
import threading
from dataclasses import asdict, dataclass, field
from typing import Any

TARGETS = ("resolved", "pinned", "hosted")


@dataclass(frozen=True)
class Settings:
    folders: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    enabled: bool = False
    target: str = "resolved"
    secret_ids: dict[str, str] = field(default_factory=dict)
    cache_ttl_minutes: int = 30
    confirm_transmission: bool = True


def as_ttl(value: Any) -> int:
    """Whole minutes from 0 to 60, else 30."""
    sound = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and value == int(value) and 0 <= value <= 60
    return int(value) if sound else 30


def as_target(value: Any) -> str:
    return value if value in TARGETS else TARGETS[0]


def as_secret_id(value: Any) -> str:
    return value if isinstance(value, str) and re.fullmatch("[a-z0-9-]{0,64}", value) else ""


def as_list(value: Any, fallback: tuple[str, ...] = ()) -> tuple[str, ...]:
    """At most 100 strings of at most 256 characters, else the fallback."""
    sound = isinstance(value, list) and len(value) <= 100 and all(isinstance(v, str) and len(v) <= 256 for v in value)
    return tuple(value) if sound else tuple(fallback)


def load_settings(raw: Any) -> Settings:
    raw = raw if isinstance(raw, dict) else {}
    secrets = raw.get("secret_ids") if isinstance(raw.get("secret_ids"), dict) else {}
    return Settings(
        folders=as_list(raw.get("folders")),
        tags=as_list(raw.get("tags")),
        enabled=raw.get("enabled") is True,
        target=as_target(raw.get("target")),
        secret_ids={t: as_secret_id(secrets.get(t)) for t in TARGETS},
        cache_ttl_minutes=as_ttl(raw.get("cache_ttl_minutes")),
        confirm_transmission=raw.get("confirm_transmission") is not False,
    )


def parse_folders(lines: str) -> tuple[str, ...] | None:
    """Folder settings as typed, one a line; None if any is absolute, climbs or names a drive, or if there are over 100."""
    found = tuple(x for x in (line.strip() for line in lines.splitlines()) if x)
    if len(found) > 100 or any(".." in f or f.startswith("/") or ":" in f for f in found):
        return None
    return found


def parse_tags(lines: str) -> tuple[str, ...] | None:
    found = tuple(x for x in (line.strip() for line in lines.splitlines()) if x)
    return found if len(found) <= 100 else None


class SettingsStore:
    """Saves snapshots one after the other, so that two saves never mix."""

    def __init__(self, path: str):
        self.path, self._lock = path, threading.Lock()

    def save(self, settings: Settings) -> None:
        text = json.dumps(asdict(settings), ensure_ascii=False)
        with self._lock:
            with open(f"{self.path}.new", "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(f"{self.path}.new", self.path)

    def load(self) -> Settings:
        try:
            with open(self.path, encoding="utf-8") as f:
                return load_settings(json.load(f))
        except (OSError, ValueError):
            return Settings()


class Credentials:
    """Keys by target: this session's, else those of a store by name, else ''. They never enter a plan."""

    def __init__(self, store: Any = None):
        self._session: dict[str, str] = {}
        self._store = store

    def set_for_session(self, target: str, key: str) -> None:
        self._session[target] = key

    def resolve(self, target: str, settings: Settings) -> str:
        if self._session.get(target):
            return self._session[target]
        name = settings.secret_ids.get(target, "")
        try:
            return (self._store(name) or "") if name and self._store else ""
        except Exception:  # noqa: BLE001  a store that fails counts as empty
            return ""
