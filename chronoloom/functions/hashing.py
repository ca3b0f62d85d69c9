"""A random number generator that SQL can repeat: hashes of keys.

``unit`` is uniform on [0, 1): the first eight hexadecimal digits of an MD5
over the parts joined by '|'. Samples drawn with it do not depend on row order,
partitioning or engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | str | int) -> Column:
    """MD5 of the parts; strings that name no column go in as F.lit."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def unit(*parts: Column | str | int) -> Column:
    return F.conv(F.substring(key(*parts), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pick(n: Column | int, *parts: Column | str | int) -> Column:
    """A uniform integer in [0, n)."""
    return F.floor(unit(*parts) * (n if isinstance(n, Column) else F.lit(n))).cast("long")
