"""Size checks that guard every explicit broadcast.

A side is broadcast only when a count of its rows and of their bytes proves it
small; beyond either bound the plan falls back to a shuffle join (and AQE may
still pick a broadcast at runtime from real shuffle sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

# Default bound for broadcast sides built from query tables (query terms,
# top-k hits), whatever their bytes are.
MAX_BROADCAST_ROWS = 2_000_000
# The same in bytes: texts in UTF-8, nested values as JSON, others 8 bytes.
MAX_BROADCAST_BYTES = 256 << 20


def _width(name: str, kind: DataType) -> Column | None:
    """Bytes of a value beyond the 8 that each value is given; None where there are no more."""
    value = F.col("`" + name.replace("`", "``") + "`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))
    return None


def count_upto(df: DataFrame, bound: int, copies: int = 1) -> int:
    """Row count of ``df``, or ``bound + 1`` if it has more, or if ``copies`` of
    its rows have more than ``MAX_BROADCAST_BYTES``: pass the columns that are to
    be broadcast, and no others.

    Counted per partition: a ``limit`` would send its rows through one task.
    """
    widths = [w for w in (_width(f.name, f.dataType) for f in df.schema.fields) if w is not None]
    total = sum((w.cast("long") for w in widths), F.lit(8 * len(df.columns)).cast("long"))
    rows, size = df.select(total.alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return bound + 1 if size * copies > MAX_BROADCAST_BYTES else min(rows, bound + 1)


def maybe_broadcast(df: DataFrame, proven_small: bool) -> DataFrame:
    """Broadcast hint only for a side whose size was checked."""
    return F.broadcast(df) if proven_small else df


def lookup_join(small: DataFrame, big: DataFrame, left_on: str, right_on: str | None = None,
                small_is_bounded: bool = True, narrow: bool = True) -> DataFrame:
    """``small LEFT JOIN big`` without shuffling ``big``.

    A broadcast hint on the preserved side of an outer join is ignored by
    Spark, so a small preserved side would force a sort-merge join that
    shuffles the big side. Instead: semi-join ``big`` with the broadcast keys
    of ``small`` (``big`` streams once), then left-join ``small`` to those
    matches, which are bounded by ``small`` because the key is unique in
    ``big`` (ids, file names). ``narrow`` says that the columns of ``big`` have
    a bound on their bytes; if not, only the keys are broadcast, and how the
    matches are joined is left to their measured size at runtime. Without a
    proven bound: a plain join.
    """
    right_on = right_on or left_on
    if not small_is_bounded:
        return small.join(big, small[left_on] == big[right_on], "left")
    keys = small.select(F.col(left_on).alias(right_on))
    matched = big.join(F.broadcast(keys), right_on, "left_semi")
    return small.join(maybe_broadcast(matched, narrow), small[left_on] == matched[right_on], "left")
