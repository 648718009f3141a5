"""What Python workers remember between tasks, kept to one operator at a time.

Workers are reused: words that one operator remembers would stay while the next stage of a pipeline runs.
"""

from __future__ import annotations

_KEPT: dict[str, list] = {}  # operator to things with a ``forget`` method
_NOW = [""]


def keep(owner: str, *things, instead: bool = False) -> None:
    """Remember that ``owner`` keeps these; ``instead`` of what it kept before."""
    _KEPT[owner] = [*([] if instead else _KEPT.get(owner, [])), *things]


def claim(owner: str) -> None:
    """From here on this worker runs ``owner``: all others forget."""
    if _NOW[0] != owner:
        for other, things in _KEPT.items():
            if other != owner:
                for thing in things:
                    thing.forget()
        _NOW[0] = owner
