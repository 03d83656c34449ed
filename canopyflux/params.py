"""Parameters of change detection."""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from typing import Any

#: Marker of a missing reflectance in source images.
NODATA = 65535
#: Factor of stored NDVI values.
NDVI_SCALE = 10000


def named(path: str) -> Any:
    """What a dotted name stands for, such as a fitter; an error if there is no such thing."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


@dataclass(frozen=True)
class CcdParams:
    """Defaults are fixed values that results depend on."""

    meow_size: int = 12
    peek_size: int = 6
    day_delta: int = 365
    avg_days_yr: float = 365.2425
    min_years: float = 1
    coefficient_min: int = 4
    coefficient_mid: int = 6
    coefficient_max: int = 8
    num_obs_factor: int = 3
    detection_bands: tuple[int, ...] = (0, 1, 2)
    tmask_bands: tuple[int, ...] = (1, 2)
    chisquare_prob: float = 0.999
    outlier_prob: float = 0.999999
    t_const: float = 4.89
    lasso_max_iter: int = 1000
    alpha: float = 2.0
