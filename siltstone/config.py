"""Settings of the daemon, read from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

MS = 1_000_000
MAX_NANOS = 2**64 - 1
DEFAULT_RETENTION_MS, DEFAULT_JANITOR_MS, DEFAULT_SKEW_MS = 7 * 86_400_000, 3_600_000, 86_400_000
REQUEST_BYTES, RESPONSE_BYTES, INGEST_BYTES, MIN_FREE_BYTES = 64 << 10, 16 << 20, 16 << 20, 512 << 20


class ConfigError(ValueError):
    pass


class Unauthenticated(ValueError):
    """No token, or none that is known."""


class Tokens:
    """Bearer tokens and their tenants; several tokens may share a tenant."""

    def __init__(self, entries: list[dict]):
        self.tenants: dict[str, str] = {}
        for e in entries:
            token, tenant = e.get("token", ""), e.get("tenant", e.get("tenant_id", ""))
            if not token or not tenant:
                raise ConfigError("a token or a tenant is empty")
            if any(c.isspace() for c in token):
                raise ConfigError("a token has white space")
            if token in self.tenants:
                raise ConfigError("a token occurs twice")
            self.tenants[token] = tenant

    def tenant(self, header: str | None) -> str:
        scheme, _, token = (header or "").strip().partition(" ")
        tenant = self.tenants.get(token.strip())
        if scheme.lower() != "bearer" or tenant is None:
            raise Unauthenticated
        return tenant


@dataclass
class Config:
    frames: str
    data: str
    tokens: Tokens
    host: str = "127.0.0.1"
    port: int = 4318
    max_dynamic_columns: int = 256
    max_depth: int = 4
    max_bytes: int = 64 << 20
    poll_ms: int = 1000
    #: Nanoseconds that rows are kept, by receive time; None keeps them.
    retention: int | None = DEFAULT_RETENTION_MS * MS
    retention_of: dict[str, int | None] = field(default_factory=dict)
    janitor_ms: int = DEFAULT_JANITOR_MS
    max_future_skew: int = DEFAULT_SKEW_MS * MS
    timeout_ms: int = 30_000
    row_cap: int = 10_000
    concurrent: int = 8
    min_free_bytes: int = MIN_FREE_BYTES

    def kept(self, tenant: str) -> int | None:
        return self.retention_of.get(tenant, self.retention)


def nanos(ms: int, what: str) -> int:
    if not isinstance(ms, int) or ms < 0 or ms * MS > MAX_NANOS:
        raise ConfigError(f"{what} is not a number of milliseconds that fits")
    return ms * MS


SECTIONS = {"storage": {"max_bytes", "max_dynamic_columns", "max_depth", "poll_interval_ms"}, "query": {"timeout_ms", "max_rows", "max_concurrent_queries"}, "retention": {"default_ms", "janitor_interval_ms", "tenants"}, "ingest": {"max_future_skew_ms"}, "readiness": {"min_free_bytes"}}
TOP = {"wal_directory", "data_directory", "listen", "tokens", *SECTIONS}


def load(text: str) -> Config:
    """Reads a configuration; unknown keys, limits of zero and retention of unknown tenants are errors."""
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError("not TOML") from e
    if unknown := set(found) - TOP:
        raise ConfigError(f"unknown key {sorted(unknown)[0]}")
    for name, keys in SECTIONS.items():
        if unknown := set(found.get(name, {})) - keys:
            raise ConfigError(f"unknown key {name}.{sorted(unknown)[0]}")
    if missing := {"wal_directory", "data_directory", "tokens"} - set(found):
        raise ConfigError(f"{sorted(missing)[0]} is missing")
    tokens = Tokens(found["tokens"])
    storage, query, retention, ingest = (found.get(s, {}) for s in ("storage", "query", "retention", "ingest"))
    host, _, port = found.get("listen", "127.0.0.1:4318").rpartition(":")
    out = Config(found["wal_directory"], found["data_directory"], tokens, host, int(port))
    for section, key, attribute in (
        (storage, "max_bytes", "max_bytes"), (storage, "poll_interval_ms", "poll_ms"), (query, "timeout_ms", "timeout_ms"), (query, "max_rows", "row_cap"),
        (query, "max_concurrent_queries", "concurrent"), (retention, "janitor_interval_ms", "janitor_ms"),
    ):
        if key in section:
            if not isinstance(section[key], int) or section[key] <= 0:
                raise ConfigError(f"{key} must be a positive number")
            setattr(out, attribute, section[key])
    out.max_dynamic_columns = storage.get("max_dynamic_columns", out.max_dynamic_columns)
    out.max_depth = storage.get("max_depth", out.max_depth)
    if "default_ms" in retention:
        out.retention = nanos(retention["default_ms"], "retention.default_ms") or None
    for tenant, ms in retention.get("tenants", {}).items():
        if tenant not in tokens.tenants.values():
            raise ConfigError("retention names an unknown tenant")
        out.retention_of[tenant] = nanos(ms, "retention of a tenant") or None
    if "max_future_skew_ms" in ingest:
        out.max_future_skew = nanos(ingest["max_future_skew_ms"], "ingest.max_future_skew_ms")
    out.min_free_bytes = found.get("readiness", {}).get("min_free_bytes", out.min_free_bytes)
    return out
