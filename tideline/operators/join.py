"""Joins of series with dimensions. Sides are broadcast by Catalyst when their measured size allows, never by hint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def samples_with_series(samples: DataFrame, series: DataFrame) -> DataFrame:
    return samples.join(series, "series_id")


def with_dimension(rollup: DataFrame, dimension: DataFrame, on: Column | Sequence[str], where: Column | None = None) -> DataFrame:
    """A rollup with its dimension's columns; the filter goes to the scans."""
    out = rollup.join(dimension, on)
    return out if where is None else out.where(where)


def only_series(points: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Points whose key is among the wanted ones."""
    return points.join(wanted, list(on), "left_semi")


def without_series(points: DataFrame, unwanted: DataFrame, on: Sequence[str]) -> DataFrame:
    return points.join(unwanted, list(on), "left_anti")

