"""Streaming forms: sessions by pause, and announcements with the last speaker kept as state (extensions)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n) of runs of events without a pause of ``gap``; batch or stream (then with ``late``)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def announcements(blocks: DataFrame, narrator: str = "Narrator") -> DataFrame:
    """(volume, pos, speaker_id) of speaker changes in a stream of blocks that arrive in order within a volume."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in batches:
            rows = []
            for r in pdf.sort_values("pos").itertuples():
                if r.is_speech and r.speaker_id != narrator:
                    if r.speaker_id != last:
                        rows.append((key[0], r.pos, r.speaker_id))
                    last = r.speaker_id
            yield pd.DataFrame(rows, columns=["volume", "pos", "speaker_id"])
        state.update((last,))

    return blocks.groupBy("volume").applyInPandasWithState(step, "volume string, pos int, speaker_id string", "last string", "append", "NoTimeout")
