"""How far the data reach: the last session that every input has."""

from __future__ import annotations

from collections.abc import Iterable


def limit(panels, refs: Iterable[str]) -> tuple[int, str | None]:
    """The last session number that all refs reach, and the ref that binds it (None if none lags)."""
    last, binding = panels.axes.n_sessions - 1, None
    for ref in sorted(set(refs)):
        if panels.exists(ref) and (own := int(panels.meta(ref).get("last_session", last))) < last:
            last, binding = own, ref
    return max(last, 0), binding


def effective_end(panels, wanted: str | None, refs: Iterable[str]) -> tuple[str, str | None]:
    """The last session to compute, and what holds it back."""
    at, binding = limit(panels, refs)
    boundary = panels.axes.date(at)
    return (boundary, binding) if wanted is None or wanted > boundary else (wanted, None)
