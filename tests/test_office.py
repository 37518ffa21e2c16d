"""One read over a folder of several kinds of files."""

import pytest

from ledgerloom.sources import office


@pytest.fixture
def folder(spark, tmp_path):
    office.use_office(spark)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "law.DOCX").write_bytes(office.docx_file([("Điều 99 <&>", 1), (" ", None), ("1. Nội dung", None), ("Mục", 2)]))
    (tmp_path / "deep" / "er" / "price.xlsx").write_bytes(office.xlsx_file({"A & B": [[None, None], ["name", "qty"], ["bolt", "3"], [None, None], ["nut", None]], "empty": []}))
    (tmp_path / "deep" / "~$lock.docx").write_bytes(b"no archive")
    (tmp_path / "notes.txt").write_text("not read")
    (tmp_path / "noextension").write_text("not read")
    return str(tmp_path)


def test_a_mixed_folder(spark, folder):
    rows = spark.read.format("office").load(folder).orderBy("kind", "sheet", "position").collect()
    assert [(r.kind, r.position, r.text, r.heading_level, r.page) for r in rows[:3]] == [("docx", 0, "Điều 99 <&>", 1, None), ("docx", 1, "1. Nội dung", None, None), ("docx", 2, "Mục", 2, None)]
    assert [(r.sheet, r.position, r.columns, r.cells) for r in rows[3:]] == [("A & B", 1, ["name", "qty"], ["bolt", "3"]), ("A & B", 2, ["name", "qty"], ["nut"])]
    assert rows[0].path.endswith("/law.DOCX")
    assert spark.read.format("office").load(f"{folder}/law.DOCX").count() == 3


def test_kinds_are_pruned_when_partitions_are_planned(spark, folder, tmp_path):
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    df = spark.read.format("office").option("partitionBytes", 1).load(folder)
    assert df.where("kind = 'docx'").count() == 3
    with pytest.raises(Exception, match="zip"):
        df.where("kind in ('xlsx')").count()


def test_an_empty_folder(spark, tmp_path):
    office.use_office(spark)
    assert spark.read.format("office").schema("path string, text string").load(str(tmp_path)).collect() == []
