"""Registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Plan:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None):
    """Register ``fn(model)`` under ``name``; ``sql`` computes the same rows on the raw tables."""

    def wrap(fn):
        from factline.plans.model import Model

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Model(spark, folder))

        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = Plan(name, run, sql)
        return fn

    return wrap
