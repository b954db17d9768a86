"""CSV cut into byte ranges of a few bytes, against what was written and Spark's reader of whole files."""

import csv
import io

import numpy as np
import pytest

from quantloom.sources import csv_records as R


def whole(spark, path):
    frame = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", True).csv(path)
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def tiny_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key in keys:
        spark.conf.unset(key)


def test_line_states():
    cases = [
        ("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('"a""b",c', False, False), ('a"b,c', False, False), ('5" pipe,"x', False, True),
        ('x""y', True, True), ('x"""', True, False), ("", False, False), ("", True, True), ('"', False, True), ('"', True, False), ('"",""', False, False),
        ('","', True, True), ('a,""', False, False), ('a,"""', False, True), ('b","c","d', True, True),
    ]
    for line, inside, want in cases:
        assert R.ends_inside(line, inside) is want, (line, inside)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_ranges_equal_whole_files(spark, tmp_path, tiny_ranges, ends):
    draw = np.random.default_rng(3)
    bits = ["", "x", "two words", 'say "hi"', "line\nbreak", "\n\n\n", ",", '"', "ü,\n", "long " * 40, "a\nb\nc\n" * 30, '5" pipe']
    rows, folder = [], tmp_path / "in"
    folder.mkdir()
    for name in "abc":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=ends)
        writer.writerow(["id", "left", "right\nside", "end"])
        for i in range(60):
            rows.append((f"{name}{i}", *(bits[k] for k in draw.integers(0, len(bits), 3))))
            writer.writerow(rows[-1])
        (folder / f"{name}.csv").write_bytes(out.getvalue().encode())
    frame = R.read_csv(spark, str(folder))
    assert frame.columns == ["id", "left", "right\nside", "end"]
    got = sorted((tuple(r) for r in frame.collect()), key=str)
    assert got == sorted((tuple(v or None for v in r) for r in rows), key=str)
    assert ends != "\n" or got == whole(spark, str(folder))
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20


def test_quotes_in_the_middle_blank_lines_and_open_ends(spark, tmp_path, tiny_ranges):
    text = 'a,b\n1,5" x\n\n2,plain\n3,6" y\n' + "\n" * 5 + "".join(f'{i},"v\n{i}"\n' for i in range(4, 40)) + '40,"left open\n41,z\n'
    path = tmp_path / "t.csv"
    path.write_text(text)
    got = {r.a: r.b for r in R.read_csv(spark, str(path)).collect()}
    assert (got["1"], got["2"], got["3"], got["17"]) == ('5" x', "plain", '6" y', "v\n17")
    assert len(got) == 40 and got["40"].startswith("left open\n41,z")


def test_headers(spark, tmp_path):
    (tmp_path / "h.csv").write_text("\ufeffa,b\n")
    frame = R.read_csv(spark, str(tmp_path / "h.csv"))
    assert frame.columns == ["a", "b"] and frame.count() == 0
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        R.read_csv(spark, str(tmp_path / "none.csv"))
