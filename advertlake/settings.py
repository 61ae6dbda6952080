"""Thresholds of the engine as one frozen value; a relaxed re-run is a new plan under settings.but(...)."""

from __future__ import annotations

import dataclasses
import datetime as dt


@dataclasses.dataclass(frozen=True)
class Settings:
    # fixed values: the published thresholds of the market, profit and gate rules
    strong_threshold: float = 0.20
    negotiable_threshold: float = 0.12
    quick_sale_factor: float = 0.95
    fixed_cost: float = 300.0
    min_strong_profit: float = 750.0
    min_comparables: int = 3
    rich_comparables: int = 8
    window_days: int = 90
    active_max_age_days: int = 60
    recent_days: int = 3
    absurd_price_ratio: float = 0.50
    thin_min_profit: float = 0.30
    min_price: float = 500.0
    max_price: float = 250_000.0
    small_pool_band: float = 0.5
    km_adjust_per_10k: float = 0.011
    km_near_limit: int = 50_000
    km_near_min: int = 8
    engine_tolerance: float = 0.3
    max_per_seller: int = 2
    min_sellers: int = 2
    strong_max_z: float = -2.0
    unknown_km_extra: int = 45_000
    unknown_km_min_age: int = 5
    fresh_try_factor: float = 0.89
    clean_threshold: float = 0.15
    clean_min_profit: float = 500.0
    verify_min_ratio: float = 0.35
    ridge_lambda: float = 0.5
    curve_min_rows: int = 8
    curve_min_years: int = 3
    curve_max_sigma: float = 0.30
    curve_max_age_slope: float = 0.02
    km_slope_limit: float = -0.010
    km_slope_fixed: float = -0.012
    book_change_limit: float = 0.15
    book_confirm_limit: float = 0.07
    book_confirm_nights: int = 2
    book_settled_min_n: int = 5
    book_settled_min_sellers: int = 3
    est_z: float = 1.53
    brand_max_sigma: float = 0.35
    est_min_curve_sellers: int = 5
    as_of: dt.date = dt.date(2026, 10, 1)

    def but(self, **changes) -> Settings:
        return dataclasses.replace(self, **changes)


#: The driver's tables are sparser in time than adverts are: wider windows, and an instant within their range.
ANALOGUE = Settings(window_days=730, active_max_age_days=365, recent_days=60, curve_max_sigma=1.0, curve_max_age_slope=1.0, as_of=dt.date(1998, 6, 1))
