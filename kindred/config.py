"""One source of truth for thresholds, weights and caps."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    """Hash bits, good keypoint matches and colour similarity that count as a matching signal."""

    phash: int = 60
    orb: int = 2
    color: float = 0.10


# The four presets, from most merging to least.
PRESETS = {
    "ultra_relaxed": Thresholds(60, 2, 0.10),
    "relaxed": Thresholds(40, 5, 0.30),
    "moderate": Thresholds(20, 10, 0.60),
    "strict": Thresholds(10, 15, 0.75),
}


@dataclass(frozen=True)
class Config:
    """Settings of the clustering pipeline; defaults are those of the production path."""

    thresholds: Thresholds = PRESETS["ultra_relaxed"]
    weight_phash: float = 0.5
    weight_color: float = 0.25
    weight_orb: float = 0.15
    weight_dct: float = 0.1
    brand_bonus: float = 0.1
    norm_bits: int = 64
    bucket_chars: int = 8
    bucket_bits: int = 2
    cut_distance: float = 0.85
    merge_cap: int = 20
    merge_phash: int = 62
    merge_color: float = 0.05
    merge_orb: float = 0.1
    skip_domains: tuple[str, ...] = field(default=())

    @classmethod
    def preset(cls, name: str, **changes) -> Config:
        return cls(thresholds=PRESETS[name], **changes)
