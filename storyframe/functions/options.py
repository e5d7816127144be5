"""Rules that choose among options: providers, devices, music, hotkeys, and small guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MUSIC_SUFFIXES = (".wav", ".ogg", ".mp3", ".flac")


def provider(requested: Column, keys: Column, order: list[tuple[str, str]], local: str, known: list[str], aliases: dict[str, str] | None = None) -> Column:
    """The provider asked for, without regard to case; ``auto`` is the first of ``order`` whose key is in ``keys``, else
    ``local``.  An alias stands for its provider; an unknown one is an error."""
    name = F.lower(requested)
    first = F.lit(local)
    for p, key in reversed(order):
        first = F.when(F.array_contains(keys, key), F.lit(p)).otherwise(first)
    for alias, p in (aliases or {}).items():
        name = F.when(name == alias, F.lit(p)).otherwise(name)
    return F.when(name == "auto", first).when(name.isin(known), name).otherwise(F.raise_error(F.concat(F.lit("unknown provider "), name)))


def device(wanted: Column, compute: Column, has_gpu: Column) -> tuple[Column, Column]:
    """(device, compute type): ``auto`` takes the GPU where there is one, and half precision there, else 8-bit integers."""
    on = F.when(wanted == "auto", F.when(has_gpu, "cuda").otherwise("cpu")).otherwise(wanted)
    return on, F.when(compute == "auto", F.when(on == "cuda", "float16").otherwise("int8")).otherwise(compute)


def styled(rows: DataFrame, styles: DataFrame, name: str = "style") -> DataFrame:
    """Rows with the settings of their style, found without regard to case and outer blanks; an unknown one is an error.

    styles: style and its settings; few, and told apart by name.
    """
    asked = F.lower(F.trim(name))
    known = styles.select(F.col("style").alias("_style"), F.struct(*[c for c in styles.columns if c != "style"]).alias("_s"))
    met = rows.join(known, asked == F.col("_style"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown style "), F.coalesce(F.col(name), F.lit("null"))))
    found = F.when(F.col("_style").isNull(), unknown.cast(met.schema["_s"].dataType)).otherwise(F.col("_s"))
    return met.withColumn("_s", found).select(*[F.col(c) for c in rows.columns], *[F.col("_s")[c].alias(c) for c in styles.columns if c != "style"])


def music(wanted: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """(by, path): the music file of the wanted name, the first suffix that is there; null without a name or a file.

    wanted: by, name, explicit.  files: stem, path.  A name that was asked for explicitly and isn't there is an error;
    a style's suggestion that isn't there means no music.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in MUSIC_SUFFIXES]), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    best = files.withColumn("_r", rank).where("_r > 0").withColumn("_n", F.row_number().over(Window.partitionBy("stem").orderBy("_r", "path"))).where("_n = 1")
    rows = wanted.join(best.select(F.col("stem").alias("name"), "path"), "name", "left")
    lost = F.col("path").isNull() & F.col("name").isNotNull() & F.col("explicit")
    return rows.select(*by, F.when(lost, F.raise_error(F.concat(F.lit("no music file "), F.col("name")))).otherwise(F.col("path")).alias("path"))


def hotkey_label(key: Column, cast: list[str], narrator: str, junk: str, junk_key: str = "x") -> Column:
    """The label of a key: 0 the narrator, 1 to 9 the cast in order, the junk key; null for all others."""
    out = F.when(key == "0", F.lit(narrator)).when(key == junk_key, F.lit(junk))
    for k, name in enumerate(cast[:9], 1):
        out = out.when(key == str(k), F.lit(name))
    return out


def hotkey_legend(names: list[str], others: list[tuple[str, str]]) -> str:
    return "  ".join([f"{k}={n}" for k, n in enumerate(names[:9], 1)] + [f"{k}={n}" for k, n in others])


def region_text(text: Column, width: Column, height: Column, least: int = 8) -> Column:
    """A region's text; empty where the region is too small to be read."""
    return F.when((width < least) | (height < least), "").otherwise(text)


def is_bubble(area: Column, hull: Column, dark: Column, panel: Column, areas=(0.004, 0.5), solidity: float = 0.75, darks=(0.01, 0.5)) -> Column:
    """Whether a contour is a bubble: its share of the panel, its share of its hull, the dark share of its box."""
    return (area / panel).between(*areas) & (hull > 0) & (F.try_divide(area, hull) >= solidity) & dark.between(*darks)


def may_stay(coexist: Column, provider_: Column, local: list[str]) -> Column:
    """Whether a loaded voice model may stay: beside a local provider only where the hardware holds both."""
    return coexist | ~provider_.isin(*local)


def is_bad_request(status: Column, error: Column, text: Column) -> Column:
    """Whether a server refused the form of a request, so that a plain one may be tried."""
    low, name = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(error, F.lit("")))
    return F.coalesce(status.isin(400, 422), F.lit(False)) | name.rlike("badrequest|unprocessable") | low.rlike("response_format|json_schema|grammar")
