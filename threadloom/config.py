"""Scoring weights, thresholds and noise rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Weight of each correlation feature.
WEIGHTS = {
    "redirect": 35.0, "subdomain": 30.0, "analytics": 40.0, "gtm": 40.0, "pixel": 40.0, "tracking": 30.0, "favicon": 30.0, "certificate": 25.0,
    "logo": 25.0, "html": 20.0, "screenshot": 20.0, "title": 15.0, "ip": 10.0, "asn": 5.0, "nameserver": 5.0, "hosting": 5.0,
}
# Least score of each confidence level.
LEVELS = (("Very High", 90), ("High", 70), ("Medium", 50), ("Low", 30))
# Least similarity by kind.
SIMILARITY = {"html": 0.90, "logo": 0.88, "screenshot": 0.90, "title": 0.85}
# The feature that a relation is evidence of.
RELATION_FEATURES = {
    "SHARES_FAVICON": "favicon", "SHARES_ANALYTICS": "analytics", "SHARES_PIXEL": "pixel",
    "SHARES_TRACKING": "tracking", "SHARES_LOGO": "logo", "USES_CERTIFICATE": "certificate",
}
NOISE_FACTOR = 0.25
HOST_TYPES = ("domain", "ip")


@dataclass(frozen=True)
class Scoring:
    """Weights and limits of one run; raises ValueError for an unknown feature, a weight outside 0..100 or levels out of order."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    levels: tuple[tuple[str, int], ...] = LEVELS
    similarity: dict[str, float] = field(default_factory=lambda: dict(SIMILARITY))
    cluster_min: int = 50
    noisy_limit: int = 150

    def __post_init__(self):
        if unknown := set(self.weights) - set(WEIGHTS):
            raise ValueError(f"unknown features: {sorted(unknown)}")
        if any(not 0 <= w <= 100 for w in self.weights.values()):
            raise ValueError("weights lie between 0 and 100")
        bounds = [b for _, b in self.levels]
        if bounds != sorted(set(bounds), reverse=True):
            raise ValueError("levels must fall strictly")

    def merged(self, **weights: float) -> Scoring:
        return Scoring(self.weights | weights, self.levels, self.similarity, self.cluster_min, self.noisy_limit)
