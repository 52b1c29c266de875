"""Names and run settings shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

# Column names and prefixes of the data model.
KEYS = ["Client", "Warehouse", "Product"]
PRED = "prediction_"
TSF = "tsfeatures_"
CLS = "class_"


@dataclass(frozen=True)
class CvConfig:
    """Rolling-origin settings (weekly data)."""

    # Horizon, number of folds, step between folds, season.
    n_windows: int = 8
    h: int = 13
    step: int = 6
    season: int = 52


DEFAULT_CV = CvConfig()
