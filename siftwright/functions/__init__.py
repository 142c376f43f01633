from .binning import bin_left_closed, bin_right_closed, edge_array, edges_passed
from .scalars import (
    adjusted_kurtosis, adjusted_skewness, digit_mask, half_ratio, hash32, is_month_end, normalised,
    ols_slope, safe_corr, safe_ratio, swap_month_day, tenure_months, trend_r2,
)
from .tails import chi2_sf, kolmogorov_sf, norm_cdf, student_t_sf

__all__ = [
    "adjusted_kurtosis", "adjusted_skewness", "bin_left_closed", "bin_right_closed", "chi2_sf",
    "digit_mask", "edge_array", "edges_passed", "half_ratio", "hash32", "is_month_end",
    "kolmogorov_sf", "norm_cdf", "normalised", "ols_slope", "safe_corr", "safe_ratio",
    "student_t_sf", "swap_month_day", "tenure_months", "trend_r2",
]
