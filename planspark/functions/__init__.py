from .periods import MONTH_NAMES, month_range, next_months
from .values import (
    clean_measure, distinct_with_null, find_period, half_up_cents, member_of, period_between, precise_avg, precise_sum,
    to_cents,
)

__all__ = [
    "MONTH_NAMES", "month_range", "next_months", "clean_measure", "distinct_with_null", "find_period",
    "half_up_cents", "member_of", "period_between", "precise_avg", "precise_sum", "to_cents",
]
