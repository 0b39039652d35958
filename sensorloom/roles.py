"""Column roles: operators take names as arguments, never fixed column names."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Names of the columns that play a part in the assembly.

    ``key`` identifies a context, ``base`` the raw section code, ``mapped`` its mapped
    code (may be null), ``position`` and ``finish`` the place, ``date`` the day of the
    reading or of the context, ``channels`` the measured values.
    """

    key: str = "key"
    base: str = "base"
    mapped: str = "mapped"
    position: str = "pos"
    finish: str = "finish"
    date: str = "d"
    context_date: str = "r_date"
    label: str = "label"
    channels: tuple[str, ...] = field(default_factory=tuple)
