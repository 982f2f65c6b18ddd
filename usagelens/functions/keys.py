"""Deduplication keys, masked identifiers and device attribution of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.names import file_stem

_PATH_KEY = r"(?i)^codex:(tc:)?(.+\.jsonl(?:\.(?:zst|zstd))?):(.+)$"


def canonical_key(key: Column) -> Column:
    """Path-shaped keys become file-stem keys; canonical and foreign keys stay as they are."""
    canonical = key.startswith("codex:file:") | key.startswith("codex:tc:file:")
    path_shaped = key.rlike(_PATH_KEY)
    rebuilt = F.concat(
        F.lit("codex:"),
        F.regexp_extract(key, _PATH_KEY, 1),
        F.lit("file:"),
        file_stem(F.regexp_extract(key, _PATH_KEY, 2)),
        F.lit(":"),
        F.regexp_extract(key, _PATH_KEY, 3),
    )
    return F.when(~canonical & path_shaped, rebuilt).otherwise(key)


def key_stem(key: Column) -> Column:
    """File stem inside a canonical file key, null for other keys."""
    stem = F.regexp_extract(canonical_key(key), r"^codex:(?:tc:)?file:(.+):[^:]+$", 1)
    return F.when(stem != "", stem)


def masked_id(domain: str, value: Column) -> Column:
    """Stable pseudonym in UUID shape; the domain keeps id spaces apart."""
    digest = F.sha2(F.concat(F.lit(domain + ":"), F.coalesce(value, F.lit(""))), 256)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in parts])


def under_root(path: Column, root: Column | str) -> Column:
    """Path equals the root or lies below it, with the separator as border."""
    r = F.lit(root) if isinstance(root, str) else root
    bare = F.regexp_replace(r, r"[/\\]$", "")
    return (path == bare) | path.startswith(F.concat(bare, F.lit("/"))) | path.startswith(
        F.concat(bare, F.lit("\\"))
    )


def _any_root(path: Column, roots: list[str]) -> Column:
    out = F.lit(False)
    for root in roots:
        out = out | under_root(path, root)
    return out


def source_device(
    path: Column, data_dir: str, known_roots: list[str], extra_roots: list[str]
) -> Column:
    """Device a file was collected on: remote exports, mirrors, or this machine."""
    out = None
    for folder, device in fixed.REMOTE_FOLDERS:
        hit = under_root(path, f"{data_dir}/remote/{folder}")
        out = (F if out is None else out).when(hit, F.lit(device))
    return (
        out.when(_any_root(path, extra_roots), F.lit("unknown"))
        .when(_any_root(path, known_roots), F.lit("local"))
        .otherwise(F.lit("unknown"))
    )
