"""Paths, timestamps and subtitle fields as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\S+"


def path_parts(path: Column) -> dict[str, Column]:
    """Directory, name, lower-case stem and lower-case extension; a leading dot begins no extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return {"dir": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "name": name, "stem": F.lower(F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)), "ext": F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))}


def exif_datetime(text: Column) -> Column:
    """2025:06:23 08:25:01 as 2025-06-23T08:25:01, null for anything shorter."""
    t = F.trim(text)
    return F.when(F.length(t) >= 19, F.concat(F.translate(F.substring(t, 1, 10), ":", "-"), F.lit("T"), F.substring(t, 12, 8)))


def timestamp_secs(text: Column) -> Column:
    """Seconds of YYYY-MM-DDTHH:MM:SS from a fixed origin; only months 1-12 and days 1-31 are checked, days past a month's end roll over."""
    n = lambda a, k: F.substring(text, a, k).try_cast("int")
    y, mo, d = n(1, 4), n(6, 2), n(9, 2)
    days = F.datediff(F.make_date(F.when(mo.between(1, 12), y), F.when(mo.between(1, 12), mo), F.lit(1)), F.lit("1970-01-01").cast("date")) + d - 1
    ok = (F.length(text) >= 19) & mo.between(1, 12) & d.between(1, 31)
    return F.when(ok, days.cast("long") * 86400 + n(12, 2) * 3600 + n(15, 2) * 60 + n(18, 2))


def timecode(secs: Column) -> Column:
    return F.format_string("%02d:%02d:%05.2f", F.floor(secs / 3600), F.floor(secs / 60) % 60, secs % 60)


def mmss(secs: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(secs / 60), F.floor(secs % 60))


def point_label(n: Column) -> Column:
    """A count for people: millions or thousands with one digit."""
    return F.when(n >= 1_000_000, F.format_string("%.1f M", n / F.lit(1e6))).when(n >= 1000, F.format_string("%.1f k", n / F.lit(1e3))).otherwise(n.cast("string"))


def srt_timestamp(text: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm or HH:MM:SS.mmm; the part after the comma counts as whole milliseconds; else null."""
    part = lambda k: F.nullif(F.regexp_extract(F.trim(text), r"^(\d+):(\d+):(\d+)[,.](\d+)$", k), F.lit("")).try_cast("long")
    return part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4)


def strip_tags(line: Column) -> Column:
    """Without <...>; an open < drops the rest of the line, a stray > goes."""
    return F.regexp_replace(line, r"<[^>]*(>|$)|>", "")


def srt_tokens(payload: Column) -> Column:
    """Brackets and commas as blanks, colons as tokens of their own."""
    return F.regexp_replace(F.regexp_replace(payload, r"[\[\],]", " "), ":", " : ")


def srt_value(tokens: Column, *names: str) -> Column:
    """The last value of `name : value` under any of its names, as text."""
    return F.try_element_at(F.regexp_extract_all(tokens, F.lit(rf"(?i)(?:^|\s)(?:{'|'.join(names)})\s+:\s+({NUMBER})"), F.lit(1)), F.lit(-1))


def gps_paren(payload: Column) -> tuple[Column, Column]:
    """Latitude and longitude of GPS(a,b,alt): longitude first, unless that can't be."""
    part = lambda k: F.nullif(F.regexp_extract(payload, r"GPS\s*\(\s*([^,()\s]+)\s*,\s*([^,()\s]+)", k), F.lit("")).try_cast("double")
    a, b = part(1), part(2)
    return F.when(F.abs(a) > 90, b).when(F.abs(b) > 90, a).otherwise(b), F.when(F.abs(a) > 90, a).when(F.abs(b) > 90, b).otherwise(a)
