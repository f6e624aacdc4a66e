"""Scalar helpers: ramps, clamps, parsing, and shared tables."""

from .scalars import clamp_score, numeric, ramp_down, ramp_up, risk_flag, risk_level, safe_ratio
from .tables import discard, scratch, written

__all__ = ["clamp_score", "discard", "numeric", "ramp_down", "ramp_up", "risk_flag", "risk_level", "safe_ratio", "scratch", "written"]
