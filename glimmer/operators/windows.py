"""Year windows and thresholds of the radar, all relative to a cutoff year."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults are those of a corpus of papers; smaller panels pass their own."""

    cutoff: int = 2026
    first: int = 2012
    recent_years: int = 3
    base_from: int = 7
    base_to: int = 4
    min_volume: int = 5
    min_growth: float = 1.0
    max_rate: float = 1e-3
    max_spread: float = 0.8
    min_sources: int = 2
    weak_volume: int = 200
    min_spread_docs: int = 20
    fragment_share: float = 0.8
    min_group_docs: int = 2000
    parent_docs: int = 200
    parent_age: int = 4
    takeoff: float = 3.0
    min_future: int = 30

    @property
    def recent(self) -> tuple[int, int]:
        return self.cutoff - self.recent_years + 1, self.cutoff

    @property
    def base(self) -> tuple[int, int]:
        return max(self.first, self.cutoff - self.base_from), self.cutoff - self.base_to

    @property
    def new_since(self) -> int:
        return self.cutoff - 4
