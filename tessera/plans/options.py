"""Options of an experiment, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.regression import ForestOptions
from ..sources.structures import StructureOptions


#: Structural features that a plan can name.
FEATURES = ("distance_histogram", "distance_histogram_geometric", "distance_histogram_log", "minimum_distance", "composition", "adjacent_pairs", "adjacency", "distance_sums", "power_sums", "contact_weights", "residue_contacts", "hydrogen_bonds")


@dataclass(frozen=True)
class Options:
    """Inputs: structures, affinity, clusters, and score tables that are appended to
    (`scores`, `score_report`) or replace (`only_...`) structural features. Models:
    forest, nn (with `neighbours`), linear (of power sums); `beside` names further ones
    for the report. `feature` is one of FEATURES. Controls: random or surrogate affinity."""

    structures: str | None = None
    affinity: str | None = None
    clusters: str | None = None
    scores: str | None = None
    score_report: str | None = None
    only_scores: str | None = None
    only_score_report: str | None = None
    output: str | None = None
    histograms: str | None = None
    cluster_by: str | None = None
    fold: int = 5
    trials: int = 1
    permutations: int = 1000
    seed: int = 1
    model: str = "forest"
    beside: tuple[str, ...] = ()
    neighbours: int = 5
    equal_clusters: bool = False
    equal_clusters_in_training: bool = False
    forest: ForestOptions = field(default_factory=ForestOptions)
    reading: StructureOptions = field(default_factory=StructureOptions)
    without_type: str | None = None
    low: float = 1.0
    high: float = 10.0
    bins: int = 9
    self_reach: float = 2.0
    self_most: int = 3
    other_reach: float = 4.0
    other_most: int = 10
    feature: str = "distance_histogram"
    random_affinity: bool = False
    surrogate_affinity: bool = False
    ignore_types: tuple[str, ...] = ()
    years: tuple[int, int] = (0, 9999)
    least_value: float = 0.0
    most_value: float = 1.0

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(0 < self.forest.data_bag <= 1 and 0 < self.forest.feature_bag <= 1, "bags lie in (0, 1]")
        need(self.forest.trees >= 1 and self.forest.leaf >= 1, "trees and leaf are at least 1")
        need(self.bins >= 1 and 0 <= self.low < self.high, "bins are at least 1, and low lies under high")
        need(self.low > 0 or self.feature != "distance_histogram_log", "logarithmic bins begin over 0")
        need(self.fold >= 2 and self.trials >= 1 and self.permutations >= 0, "fold is at least 2, trials 1, permutations 0")
        need(self.years[0] <= self.years[1], "the first year is not after the last")
        need(self.least_value <= self.most_value, "the least value is not over the most")
        need({self.model, *self.beside} <= {"forest", "nn", "linear"}, "models are forest, nn or linear")
        need(self.permutations != 1, "one permutation gives no p-value")
        need(self.feature in FEATURES, f"feature is one of {', '.join(FEATURES)}")
        need(self.neighbours >= 1, "neighbours are at least 1")
        need(self.cluster_by in (None, "composition", "alignment"), "cluster_by is composition or alignment")
        need(not (self.random_affinity and self.surrogate_affinity), "one control at a time")
        need(not ((self.scores or self.score_report) and (self.only_scores or self.only_score_report)), "scores are appended or replace features, not both")
        need(self.self_reach > 0 and self.other_reach > 0 and self.self_most >= 1 and self.other_most >= 1, "reaches are above 0, counts at least 1")
