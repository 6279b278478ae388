"""Distances between array columns, in double precision, and the matching numpy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either vector is."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance (no root)."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def inner_product(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    return F.lit(1.0) - dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def l2_int(a: Column, b: Column) -> Column:
    """Squared distance of integer vectors, in 64-bit integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("bigint") - y.cast("bigint")) * (x.cast("bigint") - y.cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"l2": l2_squared, "ip": inner_product, "cosine": cosine}[metric](a, b)


def kernel(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances [query, row] by matrix products; only good enough to choose candidates."""
    product = queries @ rows.T
    if metric == "ip":
        return 1.0 - product
    q, r = np.einsum("nd,nd->n", queries, queries), np.einsum("nd,nd->n", rows, rows)
    if metric == "l2":
        return q[:, None] + r[None, :] - 2 * product
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(1.0 - product / np.sqrt(q[:, None] * r[None, :]), nan=np.inf)


def exact(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of pairs, added up in the order of the column expressions, so that ties are the same."""
    qr, qq, rr = (np.zeros(len(rows)) for _ in range(3))
    for x, y in zip(queries.T, rows.T):
        if metric == "l2":
            qr += (x - y) * (x - y)
            continue
        qr += x * y
        if metric == "cosine":
            qq += x * x
            rr += y * y
    if metric == "l2":
        return qr
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - (qr / np.sqrt(qq * rr) if metric == "cosine" else qr)


def slack(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each query, how far two kernel() distances may be in the wrong order by rounding."""
    unit = 16 * (queries.shape[1] + 8) * np.finfo(np.float64).eps
    q, r = np.sqrt(np.einsum("nd,nd->n", queries, queries)), np.sqrt(np.einsum("nd,nd->n", rows, rows).max(initial=0.0))
    return unit * {"l2": (q + r) ** 2, "ip": 1 + q * r, "cosine": np.ones(len(q))}[metric]
