"""All registered queries; importing a family registers it."""

from tessera.plans.catalog import audits, calendars, cleaning, ensembles, featureset, forecasts, inferences, portfolios, risks, riskgrid, sequences, sources, universes  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
