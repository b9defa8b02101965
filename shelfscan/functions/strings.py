"""Column functions for names, paths and numbers."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only, as name matching folds."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def fold(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def like_escape(term: str) -> str:
    """term with the signs of LIKE made literal, by the escape sign `!`."""
    return term.replace("!", "!!").replace("%", "!%").replace("_", "!_")


def beneath(folder: str) -> str:
    """How paths beneath a folder as typed begin: drives and network shares go on with a backslash."""
    return folder.rstrip("/\\") + ("\\" if folder[1:2] == ":" or folder.startswith("\\\\") else "/")


def within(path: Column, folder: str) -> Column:
    """path lies beneath the folder (not: is it), A to Z compared without case."""
    return ascii_lower(path).startswith(fold(beneath(folder)))


def basename(path: Column) -> Column:
    """What follows the last separator; the path itself where that is nothing."""
    last = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(last == "", path).otherwise(last)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def extension(name: Column) -> Column:
    """The lower-cased part from the last dot on; none for a name that only begins with dots."""
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1))


def root_part(path: Column) -> Column:
    """`D:\\` of a drive, `\\\\` of a network share, `/` or `\\`; nothing for a relative path."""
    drive = F.regexp_extract(path, r"^([A-Za-z]:)", 1)
    return (
        F.when(drive != "", F.concat(drive, F.lit("\\")))
        .when(path.startswith("\\\\") | path.startswith("//"), F.lit("\\\\"))
        .when(path.startswith("/"), F.lit("/"))
        .when(path.startswith("\\"), F.lit("\\"))
        .otherwise(F.lit(""))
    )


def path_parts(path: Column) -> Column:
    """The components below root_part()."""
    rest = F.regexp_replace(path, r"^([A-Za-z]:[\\/]?|[\\/]{1,2})", "")
    return F.filter(F.split(rest, r"[/\\]+"), lambda x: x != "")


def human(size: Column) -> Column:
    """B, KB, MB, GB without decimals (halves to even), TB with one, by powers of 1024: 340MB."""
    out = F.format_string("%.1fTB", size / float(1 << 40))
    for unit, power in (("GB", 30), ("MB", 20), ("KB", 10), ("B", 0)):
        value = size / float(1 << power)
        out = F.when(value < 1024, F.concat(F.bround(value, 0).cast("bigint").cast("string"), F.lit(unit))).otherwise(out)
    return F.when(size.isNotNull(), out)


def human_bytes(size: Column) -> Column:
    """B, KB, MB or GB, one decimal below ten: 1.2 GB, 340 MB."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, power in (("KB", 10), ("MB", 20), ("GB", 30)):
        value = size / float(1 << power)
        short = F.when(value < 10, F.format_string("%.1f", F.bround(value, 1))).otherwise(F.bround(value, 0).cast("bigint").cast("string"))
        out = F.when(size >= (1 << power), F.concat(short, F.lit(" " + unit))).otherwise(out)
    return out


def local_time(epoch: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in the session's time zone."""
    return F.ltrim(F.date_format(F.timestamp_seconds(F.floor(epoch)), "yyyy-MM-dd HH:mm:ss"), F.lit("+"))


def progress(line: Column) -> Column:
    """`@P k=v k=v` as a map; null for any other line."""
    return F.when(line.startswith("@P "), F.str_to_map(F.trim(F.substring(line, 4, 1_000_000)), F.lit(" +"), F.lit("=")))
