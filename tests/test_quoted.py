"""Quoted line breaks read split by split: equal to Spark's reading of whole files, whatever the splits."""

import random

import pytest

from datalathe.sources import quoted
from datalathe.sources.files import read_csv

FIELDS = [
    "plain", "1", "", "NA", '"x\ny"', '"\n"', '"a ""b"" c"', '"""\n"""', '"comma, inside"', 'inch 5"', 'mid"dle', '" lead"', '"\r\n"',
    '"many\n\n\nlines, ""quoted"",\nto the end"', "ünï", '"' + "long text\n" * 300 + '"',
]


def _text(seed, rows, end="\n", header="a,b,c"):
    rnd = random.Random(seed)
    lines = [",".join([str(i), rnd.choice(FIELDS), rnd.choice(FIELDS)]) for i in range(rows)]
    return header + end + "".join(line + end for line in lines)


@pytest.fixture
def split_at(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _rows(df):
    return [tuple(r) for r in df.orderBy("__row_id").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_whole_files_at_any_split(spark, tmp_path, split_at, end):
    path = tmp_path / "quoted.csv"
    path.write_bytes(_text(3, 120, end).encode())
    expected = _rows(read_csv(spark, str(path), multi_line=True))
    assert len(expected) == 120 and any("\n" in (r[2] or "") for r in expected)
    for size in (5000, 1000):
        split_at(size)
        assert _rows(read_csv(spark, str(path))) == expected
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 20


def test_several_files_and_their_headers(spark, tmp_path, split_at):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for i in range(3):
        (folder / f"p{i}.csv").write_bytes(_text(i, 60, header='a,"b\nB",c').encode())
    expected = _rows(read_csv(spark, str(folder), multi_line=True))
    split_at(900)
    found = read_csv(spark, str(folder))
    assert found.columns == ["__row_id", "a", "b\nB", "c"]
    assert _rows(found) == expected and len(expected) == 180
    (folder / "p9.csv").write_text('a,"b\nX",c\n1,2,3\n')
    with pytest.raises(ValueError, match="different headers"):
        read_csv(spark, str(folder))


def test_one_text_over_many_splits_an_open_end_and_surplus_fields(spark, tmp_path, split_at):
    split_at(300)
    giant = "\n".join(f"line {i}, with ""commas" for i in range(400))
    path = tmp_path / "giant.csv"
    path.write_text(f'a,b\n1,"{giant}"\n2,x\n3,"never\nclosed')
    rows = _rows(read_csv(spark, str(path)))
    assert rows == [(0, 1, giant), (1, 2, "x"), (2, 3, "never\nclosed")]
    path.write_text('a,b\n1,"x\ny",z\n')
    with pytest.raises(ValueError, match="more fields"):
        read_csv(spark, str(path))
    path.write_text('a,b\n1,"x\ny"\n2\n')
    assert _rows(read_csv(spark, str(path))) == [(0, 1, "x\ny"), (1, 2, None)]


def test_lone_carriage_returns_are_read_file_by_file(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_bytes(b'a,b\n1,"x\ry\nz"\n2,w\n')
    assert _rows(read_csv(spark, str(path))) == _rows(read_csv(spark, str(path), multi_line=True))


def test_where_texts_stay_open():
    for line, outside, inside in [
        ("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('a"b', False, False), ('"a""', True, False), ('"a"",b"', False, False),
        ('x","y', True, True), ("", False, True), ('"', True, False), ('""', False, True), ('"a"b"c,"', True, True),
    ]:
        assert (quoted.ends_inside(line, False), quoted.ends_inside(line, True)) == (outside, inside), line


def test_a_scan_planned_anew_is_noticed(spark, tmp_path, split_at):
    path = tmp_path / "planned.csv"
    path.write_text(_text(5, 300))
    split_at(4000)
    starts = quoted.split_starts(quoted.lines(spark, str(path)))
    assert len(starts) > 5
    split_at(700)
    with pytest.raises(Exception, match="ChangedSplits"):
        quoted.records(quoted.lines(spark, str(path)), starts).count()


def test_the_split_query_writes_with_all_tasks(spark, tmp_path, monkeypatch):
    from datalathe.plans import queries

    texts = [(i, f'line {i}\n"quoted", and more\n' * 3, "en", "web", 0) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    parts, write = [], queries.write_csv
    monkeypatch.setattr(queries, "write_csv", lambda d, *a, **k: (parts.append(d.rdd.getNumPartitions()), write(d, *a, **k)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task per file
    try:
        found = queries.QUERIES["csv_quoted_split"](spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert parts == [4]
    assert sorted((r["number"], r["chars"]) for r in found.collect()) == [(i, len(t)) for i, t, *_ in texts]
