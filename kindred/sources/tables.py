"""What the steps leave for later ones: contexts, wide matrices, feature tables; and spreadsheets as they come."""

from __future__ import annotations

import io
import re
import sys
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.context import Context

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # readers go to executors whole: they need no installation of this package

PARTS = ("cells", "unknown", "meta", "by_property")
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def write_context(c: Context, path: str) -> None:
    """Each table of a context as parquet; not by folders an ontology, as empty tables must keep their columns."""
    for name in PARTS:
        getattr(c, name).write.parquet(f"{path}/{name}")


def read_context(spark: SparkSession, path: str) -> Context:
    """What write_context wrote."""
    return Context(*(spark.read.parquet(f"{path}/{name}") for name in PARTS))


def write_wide(cells: DataFrame, meta: DataFrame, value: str, path: str) -> None:
    """One ontology's matrix as CSV, in order of layer and name: etype, layer, n_property, then a column a property. Names of properties are read by the driver: a schema's, not its data's."""
    names = [r[0] for r in cells.select("property").distinct().orderBy("property").toLocalIterator()]
    matrix = cells.groupBy("kg", "etype").pivot("property", names).agg(F.first(value))
    rows = meta.select("kg", "etype", "layer", "n_property").join(matrix, ["kg", "etype"])
    rows.orderBy("layer", "etype").drop("kg").write.option("header", True).csv(path)


def read_wide(spark: SparkSession, path: str, kg: str) -> DataFrame:
    """(kg, etype, property, v) of matrices that write_wide wrote, or of others whose first three columns are no properties; empty cells have no row."""
    rows = spark.read.option("header", True).csv(path)
    names = rows.columns[3:]
    if not names:
        return spark.createDataFrame([], "kg string, etype string, property string, v double")
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("property"), F.col(f"`{n}`").cast("double").alias("v")) for n in names)))
    return rows.select(F.lit(kg).alias("kg"), F.col(f"`{rows.columns[0]}`").alias("etype"), cells.alias("c")).select("kg", "etype", "c.property", "c.v").where("v is not null")


def write_features(features: DataFrame, path: str) -> None:
    """Appends feature rows to a table; several alignments and runs gather there."""
    features.write.mode("append").parquet(path)


def read_features(spark: SparkSession, *paths: str) -> DataFrame:
    """Feature rows of one or more tables, which train together."""
    return spark.read.parquet(*paths)


def _plain(text: str) -> str:
    """Characters that XML can't hold stand as _xHHHH_."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of an .xlsx file, cells as text in their columns, None where there is none."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_plain("".join(t.text or "" for t in item.iter(f"{_SHEET}t"))) for item in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        sheets = [n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        first = min(sheets, key=lambda n: int(re.sub(r"\D", "", n)))
        with z.open(first) as sheet:
            above: list[ET.Element] = []
            for event, row in ET.iterparse(sheet, ("start", "end")):
                if event == "start":
                    above.append(row)
                    continue
                above.pop()
                if row.tag != f"{_SHEET}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{_SHEET}c"):
                    at = 0
                    for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                        at = at * 26 + ord(letter) - 64
                    at = at - 1 if at else len(out)
                    value, kind = cell.find(f"{_SHEET}v"), cell.get("t")
                    text = _plain("".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                    out += [None] * (at + 1 - len(out))
                    out[at] = text
                yield out
                if above:
                    above[-1].clear()  # rows that were read leave the sheet


def read_xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """`columns` of the first sheets of all .xlsx files of a folder as text, by the names in each first row, and the file's name; one file a row goes to a task. Names that hold ~ or ._ are skipped."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.where(F.col("path").rlike(r"(?i)\.xlsx$") & ~F.element_at(F.split("path", "/"), -1).rlike(r"~|\._"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = sheet_rows(content.as_py())
                head = {name: k for k, name in enumerate(next(rows, []))}
                held: list[list[str | None]] = []

                def out(held: list[list[str | None]], file: str = file, head: dict = head) -> pa.RecordBatch:
                    at = [head.get(c) for c in columns]
                    made = [pa.array([r[k] if k is not None and k < len(r) else None for r in held], pa.string()) for k in at]
                    return pa.RecordBatch.from_arrays([*made, pa.array([file.rsplit("/", 1)[-1]] * len(held), pa.string())], [*columns, "file"])

                for row in rows:
                    held.append(row)
                    if len(held) == 10_000:
                        yield out(held)
                        held = []
                if held:
                    yield out(held)

    return files.mapInArrow(run, ", ".join(f"`{c}` string" for c in [*columns, "file"]))
