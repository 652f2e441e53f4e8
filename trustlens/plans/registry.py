"""Collects the query catalogs of every module (descriptive, statistics, ML)."""

from __future__ import annotations

import importlib

from pyspark.sql import SparkSession

CATALOG_MODULES = ["trustlens.plans.catalog", "trustlens.plans.catalog_stats", "trustlens.plans.catalog_io",
                   "trustlens.plans.catalog_extra",
                   "trustlens.plans.catalog_ml"]


def _modules():
    mods = []
    for name in CATALOG_MODULES:
        try:
            mods.append(importlib.import_module(name))
        except ModuleNotFoundError as e:
            if e.name != name:
                raise
    return mods


def all_queries():
    from trustlens.session import prepare
    out = {}
    for m in _modules():
        for k, fn in m.QUERIES.items():
            def wrapped(spark: SparkSession, sf_dir: str, _fn=fn):
                prepare(spark)
                return _fn(spark, sf_dir)
            wrapped.__doc__ = fn.__doc__
            out[k] = wrapped
    return out


def all_oracles():
    out = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
