"""Column-level functions: comparisons, arithmetic, exact sums, type widening."""

from .compare import ALIASES, between, eq, ge, gt, le, lt, neq
from .numeric import compensated_sum, divide, exact_sum, kahan_sum, widened

__all__ = ["ALIASES", "between", "compensated_sum", "divide", "eq", "exact_sum", "ge", "gt", "kahan_sum", "le", "lt", "neq", "widened"]
