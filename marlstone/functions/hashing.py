"""Content hashes, deterministic splits and hash draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_sha(text: Column) -> Column:
    """SET-03: sha256 of a text with blanks collapsed."""
    return F.sha2(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")).cast("binary"), 256)


def draw(key: Column, seed: str = "", digits: int = 12) -> Column:
    """A whole number below ``16**digits`` from sha256 of ``seed:key`` (of ``key`` alone without a seed)."""
    whole = F.concat(F.lit(f"{seed}:"), key.cast("string")) if seed else key.cast("string")
    return F.conv(F.substring(F.sha2(whole.cast("binary"), 256), 1, digits), 16, 10).cast("long")


def unit(key: Column, seed: str = "") -> Column:
    """A draw in [0, 1)."""
    return draw(key, seed) / F.lit(float(16**12))


def permille_split(key: Column, share: float) -> Column:
    """HSH-01: true where the key's ten-thousandth falls below ``share``."""
    return draw(key) % 10000 / 10000.0 < share


def three_way(key: Column, test: float, val: float) -> Column:
    """HSH-02: test first, then val, else train."""
    h = draw(key) / F.lit(float(16**12 - 1))
    return F.when(h < test, "test").when(h < test + val, "val").otherwise("train")


def percent_split(key: Column, seed: str) -> Column:
    """HSH-03: train, val and test at 80, 10 and 10 per cent."""
    h = draw(key, seed) % 100
    return F.when(h < 80, "train").when(h < 90, "val").otherwise("test")


def holdout(topic: Column, share: float) -> Column:
    """HSH-04: topics held out by eight digits of their hash; the outlier topic -1 never is."""
    return (topic.cast("string") != "-1") & (draw(topic, digits=8) / F.lit(float(16**8 - 1)) < share)


def column_key(cells: Column, most: int = 50) -> Column:
    """HSH-05: the identity of a column: its first cells joined by NUL."""
    return F.sha2(F.array_join(F.slice(cells, 1, most), "\0").cast("binary"), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """HSH-06: the RFC 4122 name-based identifier of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def uuid7(at: Column, key: Column) -> Column:
    """HSH-12: a version 7 id of a time and, in place of chance, of the sha256 of a key: a repeated task mints it again."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    r = F.sha2(key.cast("binary"), 256)
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(r, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(ms, 1, 8), F.substring(ms, 9, 4), F.concat(F.lit("7"), F.substring(r, 1, 3)), F.concat(variant, F.substring(r, 5, 3)), F.substring(r, 8, 12))


def is_uuid7(value: Column) -> Column:
    """HSH-12."""
    return value.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
