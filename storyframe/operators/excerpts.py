"""Style excerpts: windows from each segment, and the best window of each time bin without overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windows(segments: DataFrame, seconds: float, *ties: str) -> DataFrame:
    """start, end and number of segments of the run from each segment, up to the first whose end is too far.

    segments: file, pos (order within the file), start, end.  A segment longer than the window is a run by itself.
    """
    # A run ends within ``seconds`` of its start: a segment need only look into its own and the next bin of that length.
    bin_ = F.floor(F.col("start") / seconds)
    near = segments.select("file", "pos", "start", "end", F.explode(F.array(bin_, bin_ - 1)).alias("bin"))
    a = segments.select("file", F.col("pos").alias("first"), F.col("start").alias("w_start"), bin_.alias("bin"))
    seen = a.join(near, ["file", "bin"]).where((F.col("pos") >= F.col("first")) & (F.col("start") - F.col("w_start") <= seconds))
    late = (F.col("pos") > F.col("first")) & (F.col("end") - F.col("w_start") > seconds)
    runs = seen.groupBy("file", "first", "w_start").agg(F.coalesce(F.min(F.when(late, F.col("pos"))) - 1, F.max("pos")).alias("pos"))
    last = segments.select("file", "pos", "end")
    return runs.join(last, ["file", "pos"]).select("file", "first", F.col("w_start").alias("start"), "end", (F.col("pos") - F.col("first") + 1).alias("segments"))


def select(windows: DataFrame, n: int, schema: str) -> DataFrame:
    """Up to ``n`` windows of each file: per bin in turn the best (earliest of equals) that starts after the last chosen.

    windows: file, first, start, end, score, t0, t1 (of the file).  A fold over one file's windows.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first"])
        span = max(float(pdf["t1"].iloc[0] - pdf["t0"].iloc[0]), 1e-9)
        bin_ = ((pdf["start"] - pdf["t0"]) / span * n).astype(int).clip(upper=n - 1)
        limit, out = float("-inf"), []
        for b in range(n):
            pool = pdf[(bin_ == b) & (pdf["start"] >= limit)]
            if len(pool):
                best = pool.sort_values(["score", "start", "first"], ascending=[False, True, True]).iloc[0]
                out.append(best)
                limit = best["end"]
        return pd.DataFrame(out)[pdf.columns.tolist()]

    return windows.groupBy("file").applyInPandas(fold, schema)


def numbered(segments: DataFrame, *ties: str) -> DataFrame:
    return segments.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("start", "end", *ties)).cast("long"))
