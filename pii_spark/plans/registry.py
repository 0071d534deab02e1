"""All registered queries and their oracles."""

from __future__ import annotations

from pii_spark.plans import datasets, detection, evaluation, exchanges, files, vaults

_MODULES = [detection, vaults, exchanges, datasets, evaluation, files]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.oracles().items()}
