"""Text helpers: stripping, file names, chapter numbers, generated names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters that count as white space at the ends of a line.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def line_breaks(text: Column) -> Column:
    """Turn the literal `\\N` into a line break; every other tag stays."""
    return F.replace(text, F.lit("\\N"), F.lit("\n"))


def after_slash(text: Column) -> Column:
    """What follows the first `/`, or the whole text without one."""
    return F.regexp_replace(text, r"(?s)^[^/]*/", "")


def or_default(text: Column, default: str = "N/A") -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def plain_path(uri: Column) -> Column:
    """The path behind `_metadata.file_path`, which escapes blanks and percent signs but no plus signs."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_ext(name: Column) -> Column:
    """The last suffix with its dot, in its own case; empty if there is none."""
    return F.regexp_extract(name, r"[^./][^/]*?(\.[^./]+)$", 1)


def file_stem(name: Column) -> Column:
    ext = file_ext(name)
    return F.when(ext == "", name).otherwise(F.left(name, F.length(name) - F.length(ext)))


def stem_number(stem: Column) -> Column:
    """All digits of a stem read as one number; 0 without digits."""
    digits = F.regexp_replace(stem, "[^0-9]", "")
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def chapter_digits(file_upload: Column) -> Column:
    """Digits after the first `ep` that has any; null if there is none."""
    return F.nullif(F.regexp_extract(file_upload, r"ep([0-9]+)", 1), F.lit(""))


def chapter_number(file_upload: Column) -> Column:
    return chapter_digits(file_upload).try_cast("bigint")


def pad2(number: Column) -> Column:
    """Pad to two digits; longer numbers stay whole."""
    return F.format_string("%02d", number)


def subtitle_file(chapter: Column) -> Column:
    return F.format_string("%02d.ass", chapter)


def numbered_name(kind: str, number: Column, separator: str = "_") -> Column:
    return F.concat(F.lit(kind + separator), number.cast("string"))


def asset_label(media_title: Column, sequence: Column, title: Column) -> Column:
    return F.concat(media_title, F.lit(" - "), pad2(sequence), F.lit(" - "), title)


def stable_uuid(*keys: Column) -> Column:
    """A 36-character id derived from the keys, so that a re-run gives the same one."""
    digest = F.sha2(F.concat_ws("\u0001", *[k.cast("string") for k in keys]), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def json_text(text: Column) -> Column:
    """A string as a JSON literal, in quotes; null is `null`."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))
