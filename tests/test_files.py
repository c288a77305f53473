"""CSV ingest: nothing lost, whatever the splits, quotes, headers and surplus fields."""

import pytest

from datalathe.sources.files import read_csv


def _write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_rows_and_ids_survive_other_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("a,b\n" + "".join(f"{i},text {i}\n" for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        df = read_csv(spark, str(path))
        rows = df.collect()
        for size in ("40k", "10m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(df.collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["__row_id"], r["a"]) for r in rows) == [(i, i) for i in range(60_000)]


def test_quoted_line_breaks_are_read(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('a,b\n1,"x\ny"\n2,"say ""hi"", then go"\n3,plain\n')
    rows = read_csv(spark, str(path)).orderBy("__row_id").collect()
    assert [tuple(r) for r in rows] == [(0, 1, "x\ny"), (1, 2, 'say "hi", then go'), (2, 3, "plain")]


@pytest.mark.parametrize("line", ["3,z,,9", "3,z,", "3,z,1"])
def test_surplus_fields_are_an_error(spark, tmp_path, line):
    path = tmp_path / "long.csv"
    path.write_text(f"a,b\n1,x\n{line}\n")
    with pytest.raises(ValueError, match="more fields"):
        read_csv(spark, str(path))


def test_short_rows_are_filled(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("a,b\n1,x\n2\n")
    assert [tuple(r) for r in read_csv(spark, str(path)).orderBy("__row_id").collect()] == [(0, 1, "x"), (1, 2, None)]


def test_part_files_need_one_header(spark, tmp_path):
    folder = tmp_path / "parts.csv"
    _write(folder, "one.csv", "a,b\n1,x\n")
    _write(folder, "two.csv", "b,a\ny,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_csv(spark, str(folder))
    _write(folder, "two.csv", "a,b\n2,y\n")
    assert read_csv(spark, str(folder)).count() == 2
