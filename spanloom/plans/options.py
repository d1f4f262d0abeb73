"""Options of a run, checked when they are made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from spanloom.functions.planning import LENGTHS, OVERLAP

STRATEGIES = ("hybrid", "windows")


@dataclass(frozen=True)
class Options:
    """What a selection or coverage run needs to know; lengths in seconds."""

    clips: int = 12
    platform: str | None = None
    shortest: float | None = None
    longest: float | None = None
    evenly: bool = False
    cover: bool = False
    part_length: float = 90.0
    strategy: str = "hybrid"
    sizes: tuple[int, ...] = (3, 5, 7)
    stride: int = 2
    most_candidates: int = 600
    least_score: float = 40.0
    most_overlap: float = OVERLAP
    most_alike: float = 0.5
    top_share: float = 0.6

    def __post_init__(self):
        if self.platform is not None and self.platform not in LENGTHS:
            raise ValueError(f"unknown platform {self.platform!r}; one of {', '.join(LENGTHS)}")
        lo, hi = self.band
        if not 0 < lo <= hi:
            raise ValueError("the shortest clip must be longer than nothing and no longer than the longest")
        if not 0.5 <= self.top_share <= 0.7:
            raise ValueError("the speaker's share of the frame lies between 50 and 70 percent")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}; one of {', '.join(STRATEGIES)}")
        if self.clips < 1 or self.stride < 1 or not self.sizes or min(self.sizes) < 1:
            raise ValueError("counts must be at least 1")
        if self.cover and self.part_length < 3:
            raise ValueError("a part needs 3 seconds or more")

    @property
    def band(self) -> tuple[float, float]:
        """Lengths of a clip: what is named, else the platform's, else 20 to 60 seconds."""
        lo, hi = LENGTHS.get(self.platform or "", (20.0, 60.0))
        return (lo if self.shortest is None else float(self.shortest), hi if self.longest is None else float(self.longest))

    @classmethod
    def of(cls, settings: Mapping) -> Options:
        """Options of a mapping's known keys; unknown ones are left out."""
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in settings.items() if k in names})

    def but(self, **changes) -> Options:
        return replace(self, **changes)


def preset_name(name: str, most: int = 40, forbidden: str = '\\/:*?"<>|') -> str:
    """A preset's name with single blanks; raises for empty, long or unsuitable ones."""
    clean = " ".join(str(name).split())
    if not clean or len(clean) > most or any(c in forbidden for c in clean):
        raise ValueError(f"a name has 1 to {most} characters and none of {forbidden}")
    return clean
