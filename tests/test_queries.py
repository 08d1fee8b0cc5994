"""Queries without SQL, on the small test tables, against a plain reading of the same rows."""

from datetime import UTC, datetime
from pathlib import Path

import pytest

from larkspur.plans import problems, recall
from larkspur.session import table
from stamp_reference import read

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test tables here")


def plain(spark):
    """(tbl, id, stamp) -> instant of every record of the three tables."""
    roots = [(r.root_path, r.zone_name, r.date_order) for r in table(spark, SMALL, "source_roots").collect()]
    out = {}
    for tbl, stamp, path in (("episodes", "ts", "source_path"), ("memories", "created_at", "source_path"), ("locks", "locked_on", None)):
        for r in table(spark, SMALL, tbl).collect():
            zone, order = next(((z, o) for p, z, o in roots if path and r[path] and r[path].startswith(p)), ("UTC", "ymd"))
            out[(tbl, r.id, r[stamp])] = read(r[stamp], order, zone)
    return out


def test_p3_normalised(spark):
    got = problems.p3_normalised(spark, SMALL).collect()
    want = plain(spark)
    assert {(r.tbl, r.rec_id, r.stamp): r.utc_us for r in got} == want and len(got) == len(want) > 500


def test_timeline_all_forms(spark):
    got = recall.timeline_all_forms(spark, SMALL).collect()
    day = datetime.fromisoformat(recall.DAY).replace(tzinfo=UTC).timestamp() * 10**6
    want = {i for (tbl, i, _), us in plain(spark).items() if tbl == "episodes" and us is not None and day <= us < day + 86_400 * 10**6}
    assert {r.id for r in got} == want and len(got) == len(want)


def test_p3_found_is_the_part_that_needed_work(spark):
    every = {(tbl, i): us for (tbl, i, s), us in plain(spark).items()}
    got = problems.p3_found(spark, SMALL).collect()
    assert len(got) == len({(r.tbl, r.rec_id) for r in got}) > 100 and all(every[(r.tbl, r.rec_id)] == r.utc_us for r in got)
