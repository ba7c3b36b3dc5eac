"""Secret scans with multipart credential linking.

Three patterns are reported wherever they match: assignments, access key ids and long hex runs. Weaker candidates - names
of accounts, random-looking words, addresses - are reported only where complementary parts co-occur: an identifier next
to a secret, a secret next to an identifier or endpoint, an endpoint next to a secret. Next to means in the same scope:
the intervals around both, ``REACH`` characters wide, overlap inside one section of the text (sections end at empty lines).
The overlap join runs over the sorted spans of a section, so a text with many candidates costs no more than their sort.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import by_bytes

#: Characters around a span in which a part of the same credential may stand.
REACH = 240
#: Bits a character from which a word is random-looking, and characters of the stretches a long word is cut into.
LEAST_ENTROPY, STRETCH = 3.0, 256
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KEYWORDS = ("passw", "secret", "token", "api")

_NAMED_ID = re.compile(
    r"""(?:access|client|account|user|key|tenant|app)[ _-]?(?:key[ _-]?)?(?:id|name|user)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""", re.I | re.A
)
_CAPITAL_ID = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{12,40}(?![A-Za-z0-9])")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
# Every search for a weak part is linear: a run of characters is read from its start only, and its ending is tested apart.
_URL = re.compile(r"""\b[a-z][a-z0-9+.-]{1,12}://[^\s"'<>]+""", re.I | re.A)
_HOST_RUN = re.compile(r"[a-z0-9-]++(?:\.[a-z0-9-]++)*+", re.I | re.A)
_HOST_START = re.compile(r"\b[a-z0-9-]", re.I | re.A)
_HOST_END = re.compile(r"\.(?:com|net|org|io|cloud|internal|local)\b", re.I | re.A)
_PORT = re.compile(r":\d++\b", re.A)
_SECTION = re.compile(r"\n[\x20\t\r]*\n")
#: What each kind stands for, and which parts complete it.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
COMPLETED_BY = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans that are reported anyway. A pattern is searched only in texts that hold what each match of it holds."""
    found: list[Span] = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if max(map(len, text.split()), default=0) >= LEAST_HEX:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return found


def _entropy(word: str) -> float:
    return -sum(n * log2(n) for n in (count / len(word) for count in Counter(word).values()))


def _random(word: str) -> bool:
    """Whether the word, or of a long one any stretch wherever it lies between duller ones, is random-looking."""
    return _entropy(word) >= LEAST_ENTROPY or len(word) > STRETCH and any(
        _entropy(word[at : at + STRETCH]) >= LEAST_ENTROPY for at in range(0, len(word) - STRETCH // 2, STRETCH // 2)
    )


def endpoints(text: str) -> list[Span]:
    """URLs, and host names with a known ending and perhaps a port outside them."""
    urls = [(m.start(), m.end()) for m in _URL.finditer(text)]
    found, next_url = [("endpoint", *url) for url in urls], 0
    for run in _HOST_RUN.finditer(text):
        while next_url < len(urls) and urls[next_url][1] <= run.start():
            next_url += 1
        if next_url < len(urls) and urls[next_url][0] < run.end():
            continue
        start = _HOST_START.search(text, run.start(), run.end())
        ends = [m.end() for m in _HOST_END.finditer(text, start.start() + 1, run.end() + 1)] if start else []
        if ends:
            port = _PORT.match(text, ends[-1])
            found.append(("endpoint", start.start(), port.end() if port else ends[-1]))
    return found


def weak_candidates(text: str) -> list[Span]:
    found = [("identifier", m.start(1), m.end(1)) for m in _NAMED_ID.finditer(text)]
    found += [("identifier", m.start(), m.end()) for m in _CAPITAL_ID.finditer(text)]
    for m in _RANDOM.finditer(text):
        word = m[0]
        classes = bool(re.search("[a-z]", word)) + bool(re.search("[A-Z]", word)) + bool(re.search("[0-9]", word))
        if classes >= 2 and re.search("[0-9]", word) and _random(word):
            found.append(("secret", m.start(), m.end()))
    return found + endpoints(text)


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates that a complementary part, weak or not, stands next to. Spans that touch a base span are left out,
    and of weak ones that overlap the first kind wins."""
    taken = bytearray(len(text))
    for _, begin, end in base:
        taken[begin:end] = b"\1" * (end - begin)
    weak = []
    for span in weak_candidates(text):
        if taken.find(1, span[1], span[2]) < 0:
            weak.append(span)
            taken[span[1] : span[2]] = b"\1" * (span[2] - span[1])
    if not weak:
        return []
    ends = [m.start() for m in _SECTION.finditer(text)]
    section = lambda at: bisect_left(ends, at)
    by_role: dict[str, list[tuple[int, int, int]]] = {}
    for kind, begin, end in [*base, *weak]:
        by_role.setdefault(ROLES[kind], []).append((section(begin), begin, end))
    for spans in by_role.values():
        spans.sort()
        for i in range(1, len(spans)):  # from here on a span's end is the last one of those up to it in its section
            if spans[i][0] == spans[i - 1][0]:
                spans[i] = (*spans[i][:2], max(spans[i][2], spans[i - 1][2]))

    def near(role: str, begin: int, end: int) -> bool:
        spans, own = by_role.get(role, []), section(begin)
        at = bisect_left(spans, (own, end + REACH + 1, 0)) - 1
        return at >= 0 and spans[at][0] == own and spans[at][2] >= begin - REACH

    return [s for s in weak if any(near(role, s[1], s[2]) for role in COMPLETED_BY[ROLES[s[0]]])]


def _ordered(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "begin": b, "end": e} for k, b, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))]


def scan(text: str) -> list[dict]:
    base = base_spans(text)
    # A weak identifier, secret or endpoint alone is nothing; a text with neither digits nor marks has no such parts.
    return _ordered(base + linked_spans(text, base)) if base or _worth(text) else []


def _worth(text: str) -> bool:
    return ("://" in text or max(map(len, text.split()), default=0) >= 12) and any(c in text for c in "0123456789")


def find_credentials(docs: DataFrame, text_column: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with the array ``name`` of kind, begin, end (code points, end exclusive), sorted by begin, then kind.

    A null text counts as empty and has no spans. Texts are scanned whole and one by one, so repeated rows get equal
    results. A column called ``name`` is replaced.
    """

    @F.pandas_udf("array<struct<kind:string,begin:int,end:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [part["text"].fillna("").map(scan) for part in by_bytes([batch.to_frame("text")], "text")]
            yield pd.concat(parts) if parts else batch

    return docs.withColumn(name, spans(F.col(text_column)))


def op10_secrets(documents: DataFrame) -> DataFrame:
    found = find_credentials(documents.select("doc_id", "text")).select("doc_id", "spans")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
