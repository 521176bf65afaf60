"""Tier widths, origin, safety margin and retention of a table."""

from __future__ import annotations

from strata.errors import BadSchema
from strata.functions.timefn import format_duration, parse_duration, parse_timestamp

DEFAULT_TIERS = "1d"
#: a bucket is closed when it ended so long ago
MARGIN = parse_duration("2h")


def parse_tiers(text: str) -> tuple[list[int], int]:
    """``"1d,7d,28d[,origin=<timestamp>]"``: ascending widths, each a multiple of the one before, and the origin."""
    widths, origin = [], 0
    for part in text.split(","):
        part = part.strip()
        if part.startswith("origin="):
            said = part.removeprefix("origin=")
            found = int(said) if said.lstrip("-").isdigit() else parse_timestamp(said)
            if found is None:
                raise BadSchema(f"bad origin {said!r}")
            origin = found
        elif part.startswith("retain="):
            raise BadSchema("retention is set by set_retention, not in the tiers")
        else:
            try:
                widths.append(parse_duration(part))
            except ValueError as e:
                raise BadSchema(str(e)) from e
    if not widths or any(b <= a or b % a for a, b in zip(widths, widths[1:])):
        raise BadSchema(f"tiers {text!r} must ascend, each a multiple of the one before")
    return widths, origin


def make(tiers: str, base_dir: str, axis: str, margin: int = MARGIN) -> dict:
    widths, origin = parse_tiers(tiers)
    return {"tiers": widths, "margin": margin, "retain": None, "origin": origin, "base_dir": base_dir, "axis": axis}


def check_retention(policy: dict, retain: str | int | None) -> int | None:
    if retain is None:
        return None
    us = parse_duration(retain) if isinstance(retain, str) else retain
    if us < policy["tiers"][-1]:
        raise BadSchema(f"retention must be at least the largest tier, {format_duration(policy['tiers'][-1])}")
    return us
