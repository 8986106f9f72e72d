"""The flagship query used by `entry()`: the per-account risk report."""

from .flow import risk_report  # noqa: F401
