"""Streaming differences: frames arrive in order, each cell line keeps its last values.

Input order is frame order, as there is no event time: a frame that comes late
is refused, since differences already given out would be wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _LastFrame(StatefulProcessor):
    """Keeps the last frame of one row band and gives out differences in time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t int, x array<int>, w array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        cells = pd.concat(list(rows)).sort_values(["t", "x"], kind="stable")
        before: dict[int, int] = {}
        newest = -1
        if self.last.exists():
            newest, x, w = self.last.get()
            before = dict(zip(x, w, strict=True))
        out = []
        for t, frame in cells.groupby("t", sort=True):
            if t <= newest:
                raise ValueError(f"frame {t} comes after frame {newest}")
            newest = int(t)
            now = dict(zip(frame["x"].tolist(), frame["w"].tolist(), strict=True))
            out.append(pd.DataFrame({"t": newest, "y": key[0], "x": list(now), "d": [w - before.get(x, 0) for x, w in now.items()]}))
            before = now
        self.last.update((newest, list(before), list(before.values())))
        yield from out

    def close(self) -> None:
        pass


def streaming_delta_t(cells: DataFrame) -> DataFrame:
    """(t, y, x, d) of a stream of cells (t, y, x, w): the difference to the frame before;
    the first frame keeps its words.  State is one row of one frame for each y."""
    return cells.select("t", "y", "x", "w").groupBy("y").transformWithStateInPandas(
        statefulProcessor=_LastFrame(), outputStructType="t int, y int, x int, d long", outputMode="append", timeMode="None"
    )


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Events and value sums by tumbling window and type, closed by a watermark."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
