"""Limits of a run: ``None`` or "auto" (by the size of the tree), "unbounded", or a number; memory also as text such as "64MiB"."""

from __future__ import annotations

import re

Limit = int | str | None

_UNITS = {"": 1, "b": 1, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30}


def _amount(limit: Limit, auto: int, units: dict[str, int]) -> int:
    if limit is None or limit == "auto":
        return auto
    if limit == "unbounded":
        return 1 << 62
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", str(limit))
    if not m or m[2].lower() not in units:
        raise ValueError(f"invalid limit '{limit}': expected a number{' or a size in KiB, MiB or GiB' if len(units) > 1 else ''}, 'auto' or 'unbounded'")
    return int(m[1]) * units[m[2].lower()]


def fuel_for(limit: Limit, n_nodes: int) -> int:
    """Nodes that may be tried in a tree of ``n_nodes``; by itself 1,000,000 and 1,024 for each node."""
    return _amount(limit, 1_000_000 + 1024 * n_nodes, {"": 1})


def memory_for(limit: Limit, n_nodes: int) -> int:
    """Bytes that may be in use; by itself 64 MiB and 256 for each node."""
    return _amount(limit, (64 << 20) + 256 * n_nodes, _UNITS)
