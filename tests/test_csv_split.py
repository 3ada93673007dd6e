"""Quoted CSV in byte ranges equals the one-task reader, wherever the ranges are cut."""

import random

import pytest

from retentio.sources import csv_split
from retentio.sources.tables import CSV_OPTIONS, read_table


@pytest.fixture
def ranges(spark, monkeypatch):
    """Sets the size of the byte ranges that lines are read in."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    noted, size = csv_split._noted, [0]

    def cut(lines):
        old = {k: spark.conf.get(k) for k in keys}
        for k, v in zip(keys, (size[0], 0)):
            spark.conf.set(k, str(v))
        try:
            return noted(lines)
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)

    monkeypatch.setattr(csv_split, "_noted", cut)

    def to(n):
        size[0] = n
    return to


def both(spark, path):
    whole = read_table(spark, path, fmt="csv", infer_types=False, key=None)
    parts = read_table(spark, path, fmt="csv", infer_types=False, key=None, split_bytes=0, row_id="place")
    assert [f.name for f in parts.schema.fields if f.name != "place"] == whole.columns
    rows = [tuple(r) for r in parts.orderBy("place").drop("place").collect()]
    return [tuple(r) for r in whole.collect()], rows


AWKWARD = (
    'id,"te""x\nt",c\r\n'
    '1,plain,x\n'
    '2,"quoted, with comma",y\n'
    '3,"a newline\nin it and ""doubled"" quotes",z\n'
    '4,"","\n"\n'
    '\n'
    '5,a "stray" quote,x\n'
    '6,5" pipe,"tail\n\n\nof lines"\n'
    '7,"""",""""""\n'
    '8,"ends with quote""","\n""\n"\r\n'
    '9,"closed"then more,x\n'
    '10,é😀ñ,"ß\nü"\n'
    '11,"looks\n12,like,records\n13,""too"",x\n",end\n'
    '14,NA,nan\n'
    '15,few\n'
    '17,"a\r\nb",z\r\n'
    '16,"last without newline\n",z')


@pytest.mark.parametrize("size", [7, 23, 64])
def test_every_cut(spark, tmp_path, ranges, size):
    path = tmp_path / "t.csv"
    path.write_bytes(AWKWARD.encode())
    ranges(size)
    whole, parts = both(spark, str(path))
    assert len(whole) == 15 and parts == whole


@pytest.mark.parametrize("size", [9, 30, 500])
def test_lines_that_end_in_cr_lf(spark, tmp_path, ranges, size):
    path = tmp_path / "t.csv"
    path.write_bytes(b'a,b\r\n1,"x\r\ny"\r\n2,"p\nq"\r\n3,z\r\n\r\n4,"e\r"\r\n5,"\r\n"')
    ranges(size)
    whole, parts = both(spark, str(path))
    assert len(whole) == 5 and parts == whole


def test_cuts_at_each_byte_of_a_small_file(spark, tmp_path, ranges):
    text = 'a,b\n1,"x\n""y""\n"\n2,"""\n"\n'.encode()
    for pad in range(0, 12, 2):
        folder = tmp_path / f"p{pad}"
        folder.mkdir()
        # a header of growing length moves every quote and newline over the range boundaries
        (folder / "t.csv").write_bytes(b"h" * pad + text)
        ranges(12)
        whole, parts = both(spark, str(folder))
        assert len(whole) == 2 and parts == whole, pad


def test_random_tables_in_many_files(spark, tmp_path, ranges):
    r = random.Random(8)
    cells = ["x", "", "a,b", "l1\nl2", 'say ""hi""', "\n", '""', "\r\n", "é\n\nñ", "w" * 90]
    for f in range(3):
        lines = ["k,t,u"]
        for i in range(120):
            lines.append(",".join([str(i), *(f'"{r.choice(cells)}"' if r.random() < 0.6 else "p" for _ in range(2))]))
        (tmp_path / f"f{f}.csv").write_text("\n".join(lines), newline="")
    for size in (64, 700):
        ranges(size)
        whole, parts = both(spark, str(tmp_path))
        assert len(whole) == 360 and sorted(parts, key=repr) == sorted(whole, key=repr)


def test_read_by_many_tasks_with_types_and_keys(spark, tmp_path, ranges):
    rows = "".join(f'{i:06d},{i},"line one of {i}\nand two",{i / 4}\n' for i in range(4000))
    path = tmp_path / "t.csv"
    path.write_text("customer_id,n,text,x\n" + rows)
    ranges(20_000)
    df = read_table(spark, str(path), fmt="csv", split_bytes=0)
    assert dict(df.dtypes) == {"customer_id": "string", "n": "bigint", "text": "string", "x": "double"}
    assert df.where("customer_id = '000007'").first()["text"] == "line one of 7\nand two"
    assert df.selectExpr("count(*)", "sum(n)", "sum(x)").first() == (4000, 4000 * 3999 // 2, 4000 * 3999 / 8)
    places = read_table(spark, str(path), fmt="csv", split_bytes=0, row_id="place").select("place.block").distinct().count()
    assert places > 5  # ranges that records start in


@pytest.mark.parametrize("line, start, inside", [
    ("", False, True), ("a,b", False, True), ('"a,b', True, False), ('"a",b', False, False), ('""', False, True),
    ('"""', True, False), ('""""', False, True), ('x"y', False, False), ('x","y', True, True), ('x"y"', False, False),
    ('a,"b""c', True, False), ('b""c",d', False, False), ('","', False, True)])
def test_states_of_a_line(line, start, inside):
    assert csv_split.line_states(line) == (start, inside)


def test_empty_files(spark, tmp_path, ranges):
    (tmp_path / "a.csv").write_text("a,b\n")
    (tmp_path / "b.csv").write_text('a,b\n1,"x\ny"')
    ranges(4)
    whole, parts = both(spark, str(tmp_path))
    assert parts == whole == [("1", "x\ny")]
    assert CSV_OPTIONS["quote"] == '"'


def test_lines_are_not_shuffled_to_learn_their_ranges_start(spark, tmp_path, capsys):
    """One row a range goes to the lines, however small the broadcast threshold."""
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        csv_split.records(spark, str(tmp_path)).explain()
    finally:
        spark.conf.set(key, old)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
