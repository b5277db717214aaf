"""Token-set similarity of names (0 to 100) on the Indel distance."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / length of both), by a bit-parallel longest common subsequence."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & full
    common = len(a) - s.bit_count()
    return 200.0 * common / (len(a) + len(b))


@lru_cache(maxsize=100_000)
def token_set_ratio(left: str, right: str) -> float:
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(x)) for x in (a & b, a - b, b - a))
    if both and (not only_a or not only_b):
        return 100.0
    x, y = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max(indel(x, y), indel(both, x) if both else 0.0, indel(both, y) if both else 0.0)


@F.arrow_udf(T.DoubleType())
def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([token_set_ratio(x or "", y or "") for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())
