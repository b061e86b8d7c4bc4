"""Parameters and their limits."""

from __future__ import annotations

from dataclasses import dataclass

MIN_LIMIT, MAX_LIMIT, DEFAULT_LIMIT = 1, 100, 10


@dataclass(frozen=True)
class BM25Params:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class RankFusion:
    """How two ranked lists become one. ``constant`` is added to every position before its reciprocal is taken; of each
    list ``spread`` times as many places as are wanted take part, though none beyond ``deepest``."""

    constant: int = 60
    spread: int = 5
    deepest: int = 100

    def __post_init__(self) -> None:
        for name in ("constant", "spread"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    def depth(self, wanted: int) -> int:
        """Places of each list that take part when so many results are wanted."""
        return min(self.deepest, self.spread * wanted)


def checked_limit(limit: int) -> int:
    """``limit`` if a caller may ask for so many results."""
    if not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from {MIN_LIMIT} to {MAX_LIMIT}")
    return limit
