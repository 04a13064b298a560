"""The same operators on streams.

The window extraction and the row-wise encodings are column functions, so they run on a
streaming table as they are; the wrapper below is all that a stream adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.rows import add_flanks


def stream_windows(rows: DataFrame, path: str, checkpoint: str, size: int = 5) -> StreamingQuery:
    """Cuts padded windows from a stream of (sequence, start, stop) rows and appends them to a
    table, until all that has arrived is worked off."""
    out = add_flanks(rows, size)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
