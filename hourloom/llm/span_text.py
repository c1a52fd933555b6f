"""Spans (kind, start, stop) as one line of text, for digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def line(spans: Column, order: Sequence[str]) -> Column:
    """kind:start:stop, by start, then by the kind's place in order, then by stop; comma-joined."""
    rank = F.array(*[F.lit(k) for k in order])
    keyed = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(rank, s["kind"]), s["stop"], s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
