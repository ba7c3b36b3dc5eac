"""Flags of all formats are those of the layouts tried one by one, and lines without what a layout needs are not tried."""

import random

from pyspark.sql import functions as F

from loghelm.operators import parse as p

WHOLE = [
    '1.2.3.4 - - [01/Jan/2024:00:00:11 +0000] "GET /a?b=1 HTTP/1.1" 200 12 "-" "Mozilla/5.0 (X)" 1234',
    '1.2.3.4 - - [01/Jan/2024:00:00:11 +0000] "GET /a HTTP/1.1" 200 - "r" "a" 0.125',
    '1.2.3.4 - - [01/Jan/2024:00:00:11 +0000] "POST /a HTTP/1.1" 404 77',
    '1.2.3.4 - - [01/Jan/2024:00:00:11 +0000] "GET /a <x>" 200 12 "-" "b"',
    'x 1.2.3.4 - - [99/Jan/2024:00:00:11 +0000] "GET /a HTTP/1.1" 200 1x "-" "b" 9',
    '1.2.3.4 - - [01/Jan/2024:00:00:11 +0000] "GET /a HTTP/1.1" 200 zz "r HTTP/1.0" 300 5 "-" "b" 9',
    "[Mon Jan 01 00:00:11 2024] [error] [client 1.2.3.4] request /a failed",
    "2024-01-01 00:00:11 10.9.9.9 GET /a k=1 80 - 1.2.3.4 Moz+x - 200 0 0 15",
    '2024/01/01 00:00:11 [error] 7#7: *1 upstream failed, client: 1.2.3.4, server: s, request: "GET /a HTTP/1.1", host: "h1"',
    "# comment", "", "?? 1.2.3.4 7",
]
PIECES = ['"', " ", "[", "]", '"GET /a HTTP/1.1"', ' "-" "b"', "200 12", "HTTP/1.1", "#", "[client ", '] "', "\t", "-", ' - - [01/Jan/2024:00:00:11 +0000] "']


def one_by_one(lines, line):
    for name, fmt in p.FORMATS.items():
        lines = p._fields_of(lines, fmt, line, name).withColumn(name, F.split(name, "\n"))
        flag = p._valid(fmt, name, fmt.time(p._field(name, "time")))
        lines = lines.withColumn(name, flag & ~F.col(line).startswith(fmt.comment) if fmt.comment else flag)
    return lines


def test_flags_are_those_of_the_layouts(spark):
    rng, texts = random.Random(5), list(WHOLE)
    for _ in range(6000):
        text = rng.choice(WHOLE)
        for _ in range(rng.randint(1, 3)):
            i, j = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
            text = text[:i] + rng.choice([*PIECES, "", rng.choice(WHOLE)]) + text[min(j, i + 6) if rng.random() < 0.7 else i :]
        texts.append(text)
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "value string").select(p.strip(F.col("value")).alias("_line"))
    flags = p.parse_flags(frame, "_line")
    assert flags.columns == ["_line", *p.FORMATS]
    got, want = flags.collect(), one_by_one(frame, "_line").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert all(sum(bool(r[name]) for r in got) > 30 for name in p.FORMATS)
    # What a layout needs keeps it from most lines: a line is tried by few of the nine.
    tried = [sum(bool(r[0]) for r in frame.select(F.col("_line").rlike(fmt.needs)).collect()) for fmt in p.FORMATS.values()]
    assert max(tried) < len(texts)
