"""Registry of named plans: a Spark plan and, where SQL can say it, a check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from perilake.plans.medallion import TestbedLake


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[TestbedLake], DataFrame]
    check: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, check: str | None = None):
    def register(build):
        if name in PLANS:
            raise ValueError(f"plan {name} is registered twice")
        PLANS[name] = Plan(name, build, check)
        return build

    return register
