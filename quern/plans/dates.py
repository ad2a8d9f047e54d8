"""Named days and windows against the days that were collected: each falls into exactly one of five cells."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta

#: The windows that have a name.
WINDOWS = ("first_week", "mid_month", "last_week", "latest")


@dataclass(frozen=True)
class Dates:
    """observed days, days in the period without a snapshot (gap), days outside of it, the named window, and what is no day.

    clamped: a named window covers fewer days than were collected.
    """

    observed: tuple[date, ...] = ()
    gap: tuple[date, ...] = ()
    outside: tuple[date, ...] = ()
    window: str | None = None
    unparsed: tuple[str, ...] = ()
    clamped: bool = False

    @property
    def empty(self) -> bool:
        """Nothing was named at all: only then is the latest snapshot the default."""
        return not (self.observed or self.gap or self.outside or self.window or self.unparsed)


def window(name: str, calendar: Iterable[date]) -> tuple[date, ...]:
    """The collected days of a named window: the first or last seven days, the middle third of the snapshots, or the last one."""
    days = sorted(calendar)
    if not days:
        return ()
    week = timedelta(days=6)
    third = len(days) // 3
    return tuple({
        "latest": days[-1:],
        "first_week": [d for d in days if d <= days[0] + week],
        "last_week": [d for d in days if d >= days[-1] - week],
        "mid_month": days[third : len(days) - third] or days,
    }[name])


def resolved(named: Iterable[str | date], calendar: Iterable[date]) -> Dates:
    """What was named, in its cells; a named window counts only where no day is named."""
    days = sorted(set(calendar))
    observed, gap, outside, unparsed, windows = [], [], [], [], []
    for item in named:
        if item in WINDOWS:
            windows.append(item)
            continue
        try:
            day = item if isinstance(item, date) else date.fromisoformat(item)
        except ValueError:
            unparsed.append(item)
            continue
        (observed if day in set(days) else gap if days and days[0] <= day <= days[-1] else outside).append(day)
    if windows and not (observed or gap or outside):
        found = window(windows[0], days)
        return Dates(found, window=windows[0], unparsed=tuple(unparsed), clamped=windows[0] != "latest" and len(found) < len(days))
    return Dates(tuple(sorted(set(observed))), tuple(sorted(set(gap))), tuple(sorted(set(outside))), None, tuple(unparsed))


def asked(named: Iterable[str | date], calendar: Iterable[date]) -> tuple[date, ...]:
    """The snapshots that a request reads: those named, or the latest where nothing was; anything else named is refused."""
    from quern.operators.relational import ContractError

    days = list(calendar)
    found = resolved(named, days)
    if found.empty:
        return window("latest", days)
    if found.unparsed:
        raise ContractError("DATE_UNPARSED", ", ".join(found.unparsed))
    if found.gap or found.outside:
        raise ContractError("SNAPSHOT_SCOPE", ", ".join(map(str, (*found.gap, *found.outside))))
    return found.observed
