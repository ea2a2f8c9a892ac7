"""Imports every plan module so that its queries are registered."""

from shockspan.plans import (  # noqa: F401
    dashboard_plans,
    feature_plans,
    impact_plans,
    model_plans,
    series_plans,
    serving_plans,
    source_plans,
    text_plans,
)
from shockspan.plans.registry import QUERIES, checks  # noqa: F401
