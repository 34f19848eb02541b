"""Tags in front of MP3 sound, as columns: ID3 version 2.4 with UTF-8 text frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frames of title, artist, album and track.
FRAMES = {"title": "TIT2", "artist": "TPE1", "album": "TALB", "track": "TRCK"}


def _size(n: Column) -> Column:
    """Four bytes of seven bits each."""
    part = lambda by: F.shiftright(n, by).bitwiseAND(127)
    return F.unhex(F.concat(*[F.lpad(F.hex(part(by)), 2, "0") for by in (21, 14, 7, 0)]))


def _frame(name: str, text: Column) -> Column:
    body = F.concat(F.unhex(F.lit("03")), F.encode(text, "UTF-8"))
    return F.concat(F.lit(name).cast("binary"), _size(F.octet_length(body)), F.unhex(F.lit("0000")), body)


def untagged(sound: Column) -> Column:
    """The sound without a tag in front of it."""
    byte = lambda i: F.conv(F.hex(F.substring(sound, i, 1)), 16, 10).cast("int")
    size = F.shiftleft(byte(7), 21) + F.shiftleft(byte(8), 14) + F.shiftleft(byte(9), 7) + byte(10)
    return F.when(F.hex(F.substring(sound, 1, 3)) == "494433", F.substring(sound, size + 11, F.octet_length(sound))).otherwise(sound)


def tagged(sound: Column, fields: Mapping[str, Column]) -> Column:
    """The sound with one tag of the given fields (title, artist, album, track); null ones are left out, and an earlier tag goes."""
    empty = F.lit(b"")
    frames = F.concat(*[F.coalesce(_frame(FRAMES[k], c.cast("string")), empty) for k, c in fields.items()])
    return F.concat(F.unhex(F.lit("49443304000000")).substr(1, 6), _size(F.octet_length(frames)), frames, untagged(sound))
