"""All registered queries."""

from tidelight.plans import marks, rasters, scenes, series, spans, spectral  # noqa: F401
from tidelight.plans.base import ORACLE, QUERIES  # noqa: F401
