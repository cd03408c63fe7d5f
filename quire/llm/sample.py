"""A bounded sample of texts, the same in any order and partitioning of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 30
LONGEST = 5_000  # characters of a text that may be sampled, so that the sample is bounded in bytes too (20,000 rows: 100 million characters at most, a few million as a rule)


def sample_texts(df: DataFrame, text: str, rows: int) -> list[str]:
    """About the ``rows`` distinct non-empty texts of lowest hash.

    The share of the hash space that holds them is taken from the number of rows, so each
    task keeps only its part of the sample, and repeated texts are one before anything is
    sent: what reaches the driver is bounded by ``rows`` of ``LONGEST`` characters whatever the size of the table.
    """
    total = max(1, df.count())
    share = min(SPACE, -(-2 * rows * SPACE // total))
    place = F.pmod(F.xxhash64(text, F.lit("sample")), F.lit(SPACE))
    near = df.where(F.col(text).isNotNull() & (F.col(text) != "") & (F.length(text) <= LONGEST) & (place < share)).select(text).distinct()
    picked = near.repartition(1).orderBy(place, text).limit(rows)
    return [r[0] for r in picked.collect()]
