"""Members of landed ZIP archives as tables: a data source with a partition for each member.

A member is read by one task, out of the archive in the store (any that pyarrow's file systems open), without the other
members. Text has numbers parted by blanks, a row a line; a workbook's sheet has a header and rows of cells. Columns are
declared; a member that does not have them is named in the error.
"""

from __future__ import annotations

import fnmatch
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructType

from .providers import deduplicated, group_of

#: Name spaces of workbook files.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class MemberError(ValueError):
    """A member that cannot be read as declared."""


def _opened(path: str) -> zipfile.ZipFile:
    store, at = fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+://|file:", path) else f"file://{path}")
    return zipfile.ZipFile(store.open_input_file(at))


def _lines(member: IO[bytes], width: int) -> Iterator[list[str]]:
    for n, raw in enumerate(member):
        cells = raw.decode("utf-8").split()
        if cells:
            if len(cells) != width:
                raise MemberError(f"line {n + 1} has {len(cells)} values, not {width}")
            yield cells


def _column(reference: str) -> int:
    """0 for A, 26 for AA."""
    k = 0
    for c in reference.rstrip("0123456789"):
        k = 26 * k + ord(c.upper()) - 64
    return k - 1


def sheet_rows(book: IO[bytes], sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a workbook's sheet (the first, or the one of a name) as texts; empty cells are None."""
    with zipfile.ZipFile(book) as z:
        names = ElementTree.fromstring(z.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")
        found = [s for s in names if sheet is None or s.get("name") == sheet]
        if not found:
            raise MemberError(f"no sheet named {sheet}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[found[0].get(f"{_REL}id")].removeprefix("/xl/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        with z.open(f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for cell in row.findall(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is not None and value.text is not None:
                        out[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                row.clear()
                yield out


class Archive(DataSource):
    """Format "archive". Options: path; kind (blanks or sheet); pattern, a glob of member names; sheet. The schema
    begins with member and line (from 0)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(schema, dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        if schema.names[:2] != ["member", "line"] or options.get("kind") not in ("blanks", "sheet"):
            raise ValueError("an archive is read with columns member, line, ... and kind blanks or sheet")

    def partitions(self) -> list[InputPartition]:
        with _opened(self.options["path"]) as z:
            names = sorted(n for n in z.namelist() if not n.endswith("/") and fnmatch.fnmatch(n, self.options.get("pattern", "*")))
        if not names:
            raise MemberError(f"{self.options['path']} has no member like {self.options.get('pattern', '*')}")
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, fields = partition.value, self.schema.fields[2:]
        try:
            with _opened(self.options["path"]) as z, z.open(name) as member:
                if self.options["kind"] == "blanks":
                    rows, at = _lines(member, len(fields)), list(range(len(fields)))
                else:
                    rows = sheet_rows(member, self.options.get("sheet"))
                    header = [h.strip() if h else h for h in next(rows, [])]
                    missing = [f.name for f in fields if f.name not in header]
                    if missing:
                        raise MemberError(f"no columns {', '.join(missing)}")
                    at = [header.index(f.name) for f in fields]
                for line, cells in enumerate(rows):
                    yield (name, line, *(self._value(cells[k] if k < len(cells) else None, f) for k, f in zip(at, fields, strict=True)))
        except MemberError as e:
            raise MemberError(f"{name}: {e}") from None
        except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError, IndexError) as e:
            raise MemberError(f"{name}: {type(e).__name__}: {e}") from None

    @staticmethod
    def _value(text: str | None, field):
        if text is None or text == "":
            return None
        if isinstance(field.dataType, DoubleType):
            return float(text)
        if isinstance(field.dataType, LongType):
            return int(float(text))
        return text


def archive(spark: SparkSession, path: str, columns: str, kind: str, pattern: str = "*", sheet: str | None = None) -> DataFrame:
    """member, line and the columns (DDL, of double, long and string) of the members that fit the pattern."""
    spark.dataSource.register(Archive)
    options = {"path": path, "kind": kind, "pattern": pattern} | ({"sheet": sheet} if sheet is not None else {})
    return spark.read.format("archive").schema(f"member string, line long, {columns}").options(**options).load()


def protein_sheet(spark: SparkSession, path: str, features: list[str], identifier: str = "MouseID", label: str = "class", pattern: str = "*.xls*") -> DataFrame:
    """row_id, features, group (the subject: the identifier without its last part), label of a workbook in an archive."""
    rows = archive(spark, path, ", ".join([f"`{identifier}` string", f"`{label}` string", *(f"`{c}` double" for c in features)]), "sheet", pattern)
    return rows.select(F.col("line").alias("row_id"), *[F.col(f"`{c}`") for c in features], group_of(identifier).alias("group"), F.col(label).alias("label"))


def activity_parts(spark: SparkSession, path: str, names: list[str], parts: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """row_id, part, features, group (subject), label of texts in an archive: X_, y_ and subject_ of each part, joined by line.

    Feature names that repeat get counters. A part whose texts have different numbers of lines raises ValueError."""
    features = deduplicated(names)
    kinds = {"X": ", ".join(f"`{c}` double" for c in features), "y": "label long", "subject": "group long"}
    read = {k: archive(spark, path, columns, "blanks", f"*{k}_*.txt").withColumn("part", F.regexp_extract("member", rf"{k}_([^/]*)[.]txt$", 1)).where(F.col("part").isin(*parts)).drop("member") for k, columns in kinds.items()}
    out = read["X"].join(read["y"], ["part", "line"], "full").join(read["subject"], ["part", "line"], "full")
    whole = F.when(F.col(f"`{features[0]}`").isNull() | F.col("label").isNull() | F.col("group").isNull(), F.raise_error(F.concat(F.lit("texts of other lengths: "), "part", F.lit(" line "), F.col("line").cast("string"))).cast("long")).otherwise(F.col("line"))
    return out.select(F.concat_ws("-", "part", whole.cast("string")).alias("row_id"), "part", *[F.col(f"`{c}`") for c in features], F.col("group").cast("string").alias("group"), F.col("label").cast("string").alias("label"))
