"""Plans of load windows: whole months, then days."""

from __future__ import annotations

import datetime as dt


def _next_month(day: dt.date) -> dt.date:
    return (day.replace(day=1) + dt.timedelta(days=32)).replace(day=1)


def plan(start: dt.date, end: dt.date, daily_from: dt.date | None = None) -> list[tuple[dt.date, dt.date]]:
    """Half-open windows that follow one another from ``start`` to ``end``: months up to ``daily_from``, days after it."""
    out, at = [], start
    while at < end:
        if daily_from is not None and at >= daily_from:
            then = at + dt.timedelta(days=1)
        else:
            then = min(_next_month(at), daily_from or end)
        out.append((at, min(then, end)))
        at = out[-1][1]
    return out


def covered(start: dt.date, end: dt.date, last: dt.date) -> list[tuple[dt.date, dt.date]]:
    """The plan of a window, none if it begins after the ``last`` covered day; one that ends before it begins is refused."""
    if end <= start:
        raise ValueError(f"{end} isn't after {start}")
    return [] if start > last else plan(start, min(end, last + dt.timedelta(days=1)))


def distinct_places(**places: str) -> None:
    """Refuse two names for one place, as of raw and derived tables."""
    if len(set(places.values())) < len(places):
        raise ValueError(f"places have to differ: {places}")


def reconciled(owed: dict[str, int], loaded: dict[str, int]) -> list[str]:
    """Tables that are owed and weren't loaded, or not with the rows they should have."""
    return sorted(name for name, n in owed.items() if loaded.get(name) != n)
