"""Multi-line CSV files read by ranges equal the plain multi-line reader, wherever the ranges end."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talentlake.sources.csv_ranges import _Range, _compose, _follow, ends_open, read_csv_ranges
from talentlake.sources.landing import read_csv

CELLS = ["", "plain", "N/A", 'say ""hi""', "two\nlines", 'a ""q""\n\n,b"",\n""', "é\n日本語", "x,y", "\n", '""', "\r\nwin", "long " * 20]


def cell(rng):
    c = rng.choice(CELLS)
    return f'"{c}"' if any(x in c for x in '",\n\r') or rng.random() < 0.3 else c


def write(path, rows, end="\n", seed=0, tail=True):
    rng = random.Random(seed)
    body = end.join(["id,a,b,c", *(f"{i},{cell(rng)},{cell(rng)},{cell(rng)}" for i in range(rows))])
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(body + (end if tail else ""))


@pytest.fixture()
def split(spark):
    """Sets the size of the ranges for one test."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, before)


@pytest.mark.parametrize("size", [150, 100_000])
def test_equals_the_multiline_reader(spark, tmpdir_path, split, size):
    for k, (rows, end, tail) in enumerate([(60, "\n", True), (40, "\r\n", True), (1, "\n", False), (0, "\n", True), (30, "\n", False)]):
        write(os.path.join(tmpdir_path, f"part-{k}.csv"), rows, end, k, tail)
    schema = "id int, a string, b string, c string"
    plain = read_csv(spark, tmpdir_path, schema).collect()
    split(size)
    got = read_csv_ranges(spark, tmpdir_path, spark.createDataFrame([], schema).schema, position="at").orderBy("at").collect()
    key = lambda r: (r.id, r.a or "", r.b or "", r.c or "")
    assert len(got) == 131 and sorted(map(key, got)) == sorted(map(key, plain))
    by_file = {}
    for r in got:
        by_file.setdefault(r["at"].file, []).append(r.id)
    assert all(ids == sorted(ids) for ids in by_file.values())                   # landing order
    untyped = read_csv_ranges(spark, tmpdir_path)
    assert untyped.columns == ["id", "a", "b", "c"] and untyped.count() == 131


def test_a_cell_over_many_ranges_and_quotes_inside_bare_cells(spark, tmpdir_path, split):
    p = os.path.join(tmpdir_path, "x.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('\n\nid,a\n1,5" disk\n2,"' + 'line ""x""\n' * 200 + '"\n\n3,c\n4,"never closed\n5,six\n')
    split(64)
    got = {r.id: r.a for r in read_csv_ranges(spark, p).collect()}
    plain = {r.id: r.a for r in read_csv(spark, p).collect()}
    assert got == plain | {"4": plain["4"].removesuffix("\n")}                  # of a quote never closed
    assert got["1"] == '5" disk' and got["2"] == 'line "x"\n' * 200 and got["3"] == "c" and len(got) == 4


def test_a_file_is_read_by_as_many_tasks_as_ranges(spark, tmpdir_path, split):
    p = os.path.join(tmpdir_path, "x.csv")
    write(p, 2000)
    split(os.path.getsize(p) // 10)
    assert spark.read.option("lineSep", "\n").text(p).rdd.getNumPartitions() >= 10
    assert read_csv(spark, p).rdd.getNumPartitions() == 1
    assert sorted(int(r.id) for r in read_csv_ranges(spark, p).collect()) == list(range(2000))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a",\n', max_size=8), max_size=8), st.integers(1, 4))
def test_states_do_not_depend_on_the_cuts(parts, per):
    import pyarrow as pa

    lines = "".join(parts).encode().split(b"\n")
    inside, want = False, []                    # one pass over all lines
    for i, line in enumerate(lines):
        if not inside:
            want.append(i)
        inside = ends_open(line, inside)
    cuts = range(0, len(lines), per)
    rows = []
    for at in cuts:
        part = lines[at:at + per]
        quoted = [(i, x) for i, x in enumerate(part) if b'"' in x]
        (o0, l0), (o1, l1) = _follow(quoted, len(part), False), _follow(quoted, len(part), True)
        rows.append({"file": "f", "start": at, "crlf": False, "open0": o0, "open1": o1, "last0": l0, "last1": l1})
    states = _compose(pa.Table.from_pylist(rows[::-1])).to_pylist()
    got: dict = {}
    for s in states:
        out: list = []
        r = _Range(("f", s["start"]), s["crlf"], s["open"], s["from_start"], s["from_line"])
        r.add(lines[s["start"]:s["start"] + per], out)
        r.close(out, end=True)
        for _, start, line, _, _, _, body in out:
            got.setdefault(start + line, []).append(body)
    ends = [*want[1:], len(lines)]
    whole = {a: b"\n".join(lines[a:b]).decode() for a, b in zip(want, ends)}
    assert {k: "\n".join(v) for k, v in got.items()} == {k: v for k, v in whole.items() if v}
