"""Queries by name, each with its SQL counterpart where one can be written."""

from __future__ import annotations

from collections.abc import Callable

from riskweave.session import tune

QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str | Callable[[], str]] = {}


def query(name: str, oracle=None):
    def register(make):
        def run(spark, folder):
            return make(tune(spark), folder)

        run.__name__, run.__doc__ = name, make.__doc__
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = oracle
        return make

    return register


def oracles() -> dict[str, str]:
    return {name: text() if callable(text) else text for name, text in _ORACLES.items()}
