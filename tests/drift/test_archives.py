"""Archives made here: a workbook and blank-parted texts, a task for each member, bad members by name."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archives

MAIN, REL = archives._MAIN.strip("{}"), archives._REL.strip("{}")


def workbook(rows, sheet="Data"):
    """A workbook with one sheet: texts shared, numbers plain, None left out."""
    shared, cells = [], []
    for r, row in enumerate(rows, 1):
        line = ""
        for k, v in enumerate(row):
            at = f"{chr(65 + k)}{r}"
            if isinstance(v, str):
                if v not in shared:
                    shared.append(v)
                line += f'<c r="{at}" t="s"><v>{shared.index(v)}</v></c>'
            elif v is not None:
                line += f'<c r="{at}"><v>{v!r}</v></c>'
        cells.append(f'<row r="{r}">{line}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(cells)}</sheetData></worksheet>')
    return out.getvalue()


def packed(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return f"file://{path}"


def test_workbook(spark, tmp_path):
    rows = [["MouseID", "P1", "P 2", "class", "note"], ["309_1", 0.5, None, "c-CS", "x"], ["309_2", 1.25, 2, "c-CS", None], ["18899_15", None, 3.5, "t-SC", "y"]]
    path = packed(tmp_path / "m.zip", {"a/Data.xlsx": workbook(rows), "readme.txt": "no"})
    got = archives.protein_sheet(spark, path, ["P1", "P 2"]).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(0, 0.5, None, "309", "c-CS"), (1, 1.25, 2.0, "309", "c-CS"), (2, None, 3.5, "18899", "t-SC")]
    with pytest.raises(Exception, match="a/Data.xlsx: no columns P3"):
        archives.protein_sheet(spark, path, ["P3"]).collect()
    with pytest.raises(Exception, match="no sheet named Other"):
        archives.archive(spark, path, "P1 double", "sheet", "*.xlsx", "Other").collect()


def test_texts(spark, tmp_path):
    members = {}
    for part, n in (("train", 50), ("test", 20)):
        members[f"d/{part}/X_{part}.txt"] = "".join(f"  {i / 2:.3e}   -{i}.5 {i}\n" for i in range(n))
        members[f"d/{part}/y_{part}.txt"] = "".join(f"{1 + i % 6}\n" for i in range(n))
        members[f"d/{part}/subject_{part}.txt"] = "".join(f"{i // 10}\n" for i in range(n))
    path = packed(tmp_path / "h.zip", members)
    got = archives.activity_parts(spark, path, ["a", "b", "a"])
    assert got.columns == ["row_id", "part", "a", "b", "a_1", "group", "label"] and got.count() == 70
    assert tuple(got.where("row_id = 'train-7'").first()) == ("train-7", "train", 3.5, -7.5, 7.0, "0", "2")
    every = archives.archive(spark, path, "v double", "blanks", "*/y_*.txt")
    assert every.rdd.getNumPartitions() == 2 and {r["member"] for r in every.select("member").distinct().collect()} == {"d/train/y_train.txt", "d/test/y_test.txt"}


@pytest.mark.parametrize("text, message", [("1 2\n1 2 3\n", "line 2 has 3 values"), ("1 2\n1 x\n", "could not convert")])
def test_a_bad_member_is_named(spark, tmp_path, text, message):
    path = packed(tmp_path / "b.zip", {"good.txt": "1 2\n", "bad.txt": text})
    with pytest.raises(Exception, match=f"bad.txt: .*{message}"):
        archives.archive(spark, path, "a double, b double", "blanks").collect()
    assert archives.archive(spark, path, "a double, b double", "blanks", "good*").select(F.sum("b")).first()[0] == 2
    with pytest.raises(Exception, match="no member like"):
        archives.archive(spark, path, "a double", "blanks", "nothing*").collect()


def test_parts_of_other_lengths(spark, tmp_path):
    path = packed(tmp_path / "o.zip", {"X_train.txt": "1\n2\n", "y_train.txt": "1\n", "subject_train.txt": "1\n1\n"})
    with pytest.raises(Exception, match="texts of other lengths: train line 1"):
        archives.activity_parts(spark, path, ["a"], ("train",)).collect()
