"""Settings of the analysis, one immutable record; runs derive others from it."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Settings:
    output_root: str = os.environ.get("LUMENFRAME_OUTPUT", "outputs")
    seed: int = 0
    unknown_label: str = "Unknown"
    missing_assay: str = "Flex Gene Expression"
    rare_assay_cells: int = 100
    min_class_cells: int = 780
    min_batch_cells: int = 100
    major_ratio: float = 0.5
    validation_share: float = 0.2
    library_quantile: float = 0.01
    normalised_total: float = 1e4
    top_markers: int = 50
    neighbours: int = 30
    metric_cells: int = 50_000
    min_class_evaluated: int = 30
    distance_quantile: float = 0.90
    isolation_quantile: float = 0.90

    def with_changes(self, **changes) -> Settings:
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
