"""Every threshold of the market operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values of the domain
    value_floor: float = 10_000.0
    value_ceiling: float = 100_000_000.0
    underdeclared_share: float = 0.60
    area_edges: tuple[float, ...] = (50.0, 80.0, 120.0)
    trim_k: float = 1.5
    trim_least_rows: int = 4
    cap_per_area: int = 5
    bucket_width: float = 20.0
    stub_share: float = 0.5
    lag_months: int = 2
    window_months: int = 12
    trend_least_sales: int = 50
    adaptive_windows: tuple[int, ...] = (12, 24, 36)
    adaptive_least_rows: int = 30
    launch_sales: int = 5
    launch_days: int = 182
    recent_days: int = 365
    small_sample: int = 10
    index_windows: tuple[int, ...] = (3, 6, 12)
    index_least_rows: int = 200
    index_fallback_window: int = 6
    homogeneous_ratio: float = 1.25
    building_least_sales: int = 4
    discount_cut: float = 20.0
    discount_attention: float = 30.0
    neighbours: int = 3
    neighbour_km: float = 3.0
    block_high: float = 80.0
    block_medium: float = 60.0
    prospect_least_value: float = 30_000.0
    prospect_max_ratio: float = 20.0
    area_max_ratio: float = 4.0
    tolerance_first: float = 0.10
    tolerance_wide: float = 0.20
    merge_price_share: float = 0.03
    weight_resale: float = 0.35
    weight_price: float = 0.30
    weight_band: float = 0.25
    weight_prospect: float = 0.10


DEFAULT = Params()
