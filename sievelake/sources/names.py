"""Table names: patterns, dated names and rollover generations."""

from __future__ import annotations

import re
from datetime import datetime, timezone


def pattern(*elements: str) -> str:
    return "-".join([*elements, "*"])


def dated(date: datetime, layout: str, *elements: str) -> str:
    """``layout`` as of ``strftime``."""
    return "-".join([*elements, date.strftime(layout)])


def current_day(*elements: str) -> str:
    return dated(datetime.now(timezone.utc), "%Y-%m-%d", *elements)


def current_month(*elements: str) -> str:
    return dated(datetime.now(timezone.utc), "%Y-%m", *elements)


def generation(prefix: str, n: int = 1) -> str:
    return f"{prefix}-{n:06d}"


def parse_generation(name: str) -> tuple[str, int]:
    m = re.fullmatch(r"(.+)-(\d{6})", name)
    if not m:
        raise ValueError(f"not a generation: {name}")
    return m[1], int(m[2])


def next_generation(name: str) -> str:
    prefix, n = parse_generation(name)
    return generation(prefix, n + 1)


def is_generation(name: str) -> bool:
    return re.fullmatch(r".+-\d{6}", name) is not None


def generation_number(name: str) -> int:
    return parse_generation(name)[1] if is_generation(name) else 0
