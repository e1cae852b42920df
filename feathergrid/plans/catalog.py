"""Imports every plan module so that its queries are registered."""

from feathergrid.plans import aggregates, cleaning, flagship, graphs, joining, modelling, portfolio, preparing, regressions, scalars, sources, walking, windows  # noqa: F401
from feathergrid.plans.registry import ORACLES, QUERIES  # noqa: F401
