"""Registered queries over the driver tables, with their reference SQL."""

from tickweave.plans import checks, costs, files, logs, market, risk, scores, slabs, stores, streams  # noqa: F401
