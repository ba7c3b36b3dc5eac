"""Case-insensitive substring tests over columns.

Word lists are long, so the tests are written as SQL text and parsed in one call; building
them from one Column object per word would cost more than many a query.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A SQL string literal. ``$`` is escaped as well, or it could name a variable."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
    return f"'{escaped}'"


def contains_sql(column: str, words: list[str]) -> str:
    """SQL: the lower-cased ``column`` (name or expression) holds one of the words."""
    wanted = [word.lower() for word in words]
    # A word that contains another one adds nothing.
    needed = [w for w in wanted if not any(o != w and o in w for o in wanted)]
    return "(" + " OR ".join(f"contains(lower({column}), {quoted(w)})" for w in needed) + ")"


def contains_any(column: str, words: list[str]) -> Column:
    """True where the column holds one of the words in any case; NULL stays NULL."""
    return F.expr(contains_sql(column, words))


def _fragment(pattern: str) -> str:
    """The longest piece of an ILIKE pattern between its wildcards."""
    return max(re.split("[%_]", pattern.lower()), key=len)


def ilike_sql(columns: list[str], patterns: list[str]) -> str:
    """SQL: any column is ILIKE any pattern. NULL columns do not match.

    A plain ``%word%`` is looked up once in the columns joined by newline, which no
    log field contains. A pattern with an inner wildcard could span fields there, so
    it is tested against each column, once its longest fragment is known to occur.
    """
    plain = [p for p in patterns if p[0] == p[-1] == "%" and not set(p[1:-1]) & {"%", "_"}]
    joined = f"concat_ws('\\n', {', '.join(columns)})"
    tests = [contains_sql(joined, [p[1:-1] for p in plain])] if plain else []
    for pattern in patterns:
        if pattern not in plain:
            each = " OR ".join(f"coalesce({c} ILIKE {quoted(pattern)}, false)" for c in columns)
            tests.append(f"({contains_sql(joined, [_fragment(pattern)])} AND ({each}))")
    return "(" + " OR ".join(tests) + ")"


def ilike_any(columns: list[str], patterns: list[str]) -> Column:
    return F.expr(ilike_sql(columns, patterns))
