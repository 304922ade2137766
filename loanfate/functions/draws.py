"""Random draws that do not depend on partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(key, seed: int = 7) -> Column:
    """Uniform draw in [0, 1) from the md5 of a key column.

    Unlike ``rand(seed)`` the draw stays the same when partitions move, when a lost
    executor's task runs again, and when the same loan is read in another job. Rows without
    a key share one draw, so that a split still puts each of them in one part.
    """
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
