"""URL splitting, percent-decoding and templating."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a whole path segment that is a number, or 10 and more token characters
# (which takes in UUIDs and hashes), is an identifier.
ID_SEGMENT = r"(?<=/)(?:\d+|[a-zA-Z0-9_-]{10,})(?=/|$)"


def percent_decode(column: Column) -> Column:
    """Decode ``%xx``; ``+`` stays a plus and a malformed ``%`` stays as it is."""
    guarded = F.regexp_replace(column, r"%(?![0-9A-Fa-f]{2})", "%25")
    guarded = F.replace(guarded, F.lit("+"), F.lit("%2B"))
    return F.when(column.contains("%"), F.try_url_decode(guarded)).otherwise(column)


def target_path(target: Column) -> Column:
    """Part of a request target before the first ``?``."""
    return F.substring_index(target, "?", 1)


def target_query(target: Column) -> Column:
    """Part after the first ``?``, NULL without one."""
    at = F.instr(target, "?")
    return F.when(at > 0, F.substring(target, at + 1, F.length(target)))


def url_template(column: Column) -> Column:
    """Replace identifier segments by ``{id}``."""
    return F.regexp_replace(column, ID_SEGMENT, "{id}")
