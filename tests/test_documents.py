"""Documents put together from ordered lines are valid whatever the rows."""

import json
import os

import pytest

from leakscan.operators import report

ROWS = [(None, True, "key", 3), ("a", True, "key", 4), ("a", True, "key", 4), ("a", True, "card", 2), ("b", False, None, 0), (None, True, "key", 3), ("c", True, None, None)]
SCHEMA = "file string, blocked boolean, pattern_name string, score int"


def document(lines, folder):
    report.write_lines(lines, str(folder))
    parts = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    return json.loads("".join(open(f"{folder}/{n}", encoding="utf-8").read() for n in parts))


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[1:3], ROWS[4:5], []])
def test_findings(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = document(report.findings_lines(df), tmp_path / "d")
    blocked = [r for r in rows if r[1]]
    assert (made["scanned"], made["blocked"]) == (len(rows), len(blocked))
    got = [(f.get("file"), f["blocked"], f.get("pattern_name"), f.get("score")) for f in made["findings"]]
    assert sorted(got, key=repr) == sorted(blocked, key=repr)
    files = [f.get("file") or "" for f in made["findings"]]
    assert files == sorted(files)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_sarif(spark, tmp_path, rows):
    found = report.findings(spark.createDataFrame(rows, SCHEMA).repartition(3))
    run = document(report.sarif_lines(found), tmp_path / "d")["runs"][0]
    blocked = [r for r in rows if r[1]]
    assert len(run["results"]) == len(blocked)
    assert sorted({r.get("ruleId") or "" for r in run["results"]}) == sorted({r[2] or "" for r in blocked})
    assert all(r["message"]["text"] for r in run["results"])
