"""The folder that the ingest queries read has files of bounded size, and the copy in it is known as one."""

from pathlib import Path

import pytest

from loghelm.plans import catalog
from loghelm.session import scratch_dir

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["stream_folder_ingest", "ingest_rejects"])
def test_files_are_bounded_and_results_the_same(spark, monkeypatch, name):
    made = []
    monkeypatch.setattr(catalog, "scratch_dir", lambda *given: made.append(scratch_dir(*given)) or made[-1])
    whole = sorted(map(str, catalog.QUERIES[name](spark, SMALL).collect()))
    monkeypatch.setattr(catalog, "FILE_ROWS", 1000, raising=False)
    parts = sorted(map(str, catalog.QUERIES[name](spark, SMALL).collect()))
    assert parts == whole
    raw = [sorted(f.stat().st_size for f in (Path(folder) / "raw").rglob("part-*")) for folder in made]
    assert len(raw[1]) > len(raw[0]) and raw[1][-1] < raw[0][-1] / 2
