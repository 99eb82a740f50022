"""Files that Spark has no format for: word vectors in word2vec's binary form and spreadsheets, out and in as data sources.

Paths are folders or files of stores that Arrow's file systems open (local ones, hdfs, s3, gs). Writers append to a folder: tasks write to a folder of the job below it, and
only files of tasks that ended are moved out of it when all have, so a task that is lost or runs twice leaves nothing.
"""

from __future__ import annotations

import re
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installation of this package

#: Bytes of a binary file that are in memory at a time, beside one record.
PIECE = 8_000_000
#: Records of a task that reads vectors, and of a file that one writes.
RECORDS = 65_536
# Rows of one sheet below its header, and characters of one cell.
SHEET_ROWS, CELL_CHARS = 1_048_574, 32_767


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path)) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


# ---- out


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FolderWriter(DataSourceArrowWriter):
    """Moves what tasks made into the folder when all have ended. `files` makes a task's files by its rows; `new(k)` gives the path of its k-th."""

    ending = ""

    def __init__(self, options: dict[str, str]):
        self.options, self.path, self.job = options, options["path"].rstrip("/"), f"_job-{uuid.uuid4().hex}"

    def files(self, store: fs.FileSystem, new, batches: Iterator[pa.RecordBatch]) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        context, names = TaskContext.get(), []
        store.create_dir(f"{root}/{self.job}", recursive=True)

        def new() -> str:
            names.append(f"part-{context.partitionId():05d}-{len(names):03d}-{self.job[5:13]}-{context.taskAttemptId()}{self.ending}")
            return f"{root}/{self.job}/{names[-1]}"

        self.files(store, new, iterator)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


def cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[Iterator[pa.RecordBatch]]:
    """Runs of batches of `rows` rows each; the last may have less. A run is to be read before the next."""
    left = None  # rest of a batch that a run's end cut
    source = iter(batches)

    def run(first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal left
        free, b = rows, first
        while b is not None:
            yield b.slice(0, free)
            if b.num_rows > free:
                left = b.slice(free)
                return
            free -= b.num_rows
            if not free:
                return
            b = next(source, None)

    while (b := left if left is not None else next(source, None)) is not None:
        left = None
        if b.num_rows:
            yield run(b)


class VectorWriter(FolderWriter):
    ending = ".bin"

    def files(self, store: fs.FileSystem, new, batches: Iterator[pa.RecordBatch]) -> None:
        for run in cut(batches, int(self.options.get("records", RECORDS))):
            out, width, count = bytearray(), None, 0
            for b in run:
                for word, vector in zip(b.column("word").to_pylist(), b.column("embedding"), strict=True):
                    values = vector.values
                    if not word or re.search(r"[ \n]", word) or values is None or values.null_count or not len(values):
                        raise ValueError(f"no record of a vector file: word {word!r}")
                    if width not in (None, len(values)):
                        raise ValueError(f"vectors of {width} and {len(values)} places in one file")
                    width, count = len(values), count + 1
                    out += word.encode() + b" " + values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() + b"\n"
            with store.open_output_stream(new()) as f:
                f.write(f"{count} {width}\n".encode())
                f.write(out)


class SheetWriter(FolderWriter):
    """Each sheet is packed as its rows come, so no sheet is in memory."""

    ending = ".xlsx"
    # Parts of a spreadsheet of one sheet; style 1 is bold.
    MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    PACKAGE = "http://schemas.openxmlformats.org/package/2006"
    KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"

    def parts(self) -> dict[str, str]:
        relation = lambda kind, target: f'<Relationships xmlns="{self.PACKAGE}/relationships">{"".join(f"""<Relationship Id="rId{i}" Type="{self.DOC}/{k}" Target="{t}"/>""" for i, (k, t) in enumerate(zip(kind, target, strict=True), 1))}</Relationships>'
        return {
            "[Content_Types].xml": f'<Types xmlns="{self.PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{self.KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{self.KIND}.styles+xml"/>'
            f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{self.KIND}.worksheet+xml"/></Types>',
            "_rels/.rels": relation(["officeDocument"], ["xl/workbook.xml"]),
            "xl/_rels/workbook.xml.rels": relation(["worksheet", "styles"], ["worksheets/sheet1.xml", "styles.xml"]),
            "xl/workbook.xml": f'<workbook xmlns="{self.MAIN}" xmlns:r="{self.DOC}"><sheets><sheet name="{escape(self.options.get("sheet", "Sheet1"))}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/styles.xml": f'<styleSheet xmlns="{self.MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
            '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        }

    def files(self, store: fs.FileSystem, new, batches: Iterator[pa.RecordBatch]) -> None:
        for run in cut(batches, int(self.options.get("rows", SHEET_ROWS))):
            with store.open_output_stream(new()) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in self.parts().items():
                    z.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
                with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                    at = 0
                    for b in run:
                        if not at:
                            width = f'<cols><col min="1" max="{b.num_columns}" width="{int(self.options.get("width", 30))}" customWidth="1"/></cols>'
                            sheet.write(f'<worksheet xmlns="{self.MAIN}">{width}<sheetData>{sheet_row(1, b.schema.names, " s=\"1\"")}'.encode())
                            at = 1
                        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                            at += 1
                            sheet.write(sheet_row(at, row).encode("utf-8", "replace"))
                    sheet.write(b"</sheetData></worksheet>")


def column_letters(k: int) -> str:
    """A, B, ... Z, AA, ... of the k-th column, from 0."""
    return (column_letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def cell_text(value) -> str:
    """As XML holds it: characters that it can't hold, and underscores that would read as such, stand as _xHHHH_."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0B-\x1F\uFFFE\uFFFF]", lambda m: f"_x{ord(m[0]):04X}_", str(value))
    return escape(text)


def sheet_row(at: int, row, style: str = "") -> str:
    """A row's cells as text; nulls leave gaps, a cell that is longer than a sheet can hold is an error."""
    cells = []
    for k, value in enumerate(row):
        if value is None:
            continue
        if len(str(value).encode("utf-16-le", "surrogatepass")) > 2 * CELL_CHARS:
            raise ValueError(f"a cell of column {k + 1} has more than {CELL_CHARS} characters")
        cells.append(f'<c r="{column_letters(k)}{at}" t="inlineStr"{style}><is><t xml:space="preserve">{cell_text(value)}</t></is></c>')
    return f'<row r="{at}">{"".join(cells)}</row>'


# ---- in


@dataclass
class Span(InputPartition):
    """Records from byte `start` of a file, the `place`-th and those after it, `count` of them."""

    file: str
    start: int
    place: int
    count: int
    width: int


class VectorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.records, self.errors = options["path"], int(options.get("records", RECORDS)), options.get("errors", "strict")

    def partitions(self) -> list[Span]:
        """Where each span begins: records have no common length, so one pass over a file finds them. It keeps no record."""
        store, root = opened(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
        files = sorted(i.path for i in listed if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
        out: list[Span] = []
        for file in files:
            with store.open_input_stream(file, compression=None) as f:
                held = Held(f, file)
                head = re.fullmatch(rb"(\d+) (\d+)\s*", held.upto(b"\n"))
                if not head or not int(head[2]):
                    raise ValueError(f"{file}: no vector file: its first line isn't a count and a width")
                count, width = int(head[1]), int(head[2])
                for k in range(0, count, self.records):
                    n = min(self.records, count - k)
                    out.append(Span(file, held.at, k, n, width))
                    if k + n < count:  # the last span's end is its reader's to find
                        for _ in range(n):
                            held.upto(b" ")
                            held.take(4 * width)
        return out

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no span at all
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.file) as f:
            f.seek(partition.start)
            held = Held(f, partition.file, partition.start)
            step = max(1, min(10_000, PIECE // (4 * partition.width)))
            for k in range(0, partition.count, step):
                n = min(step, partition.count - k)
                words, values = [], []
                for _ in range(n):
                    words.append(held.upto(b" ").lstrip(b"\n").decode("utf-8", self.errors))
                    values.append(held.take(4 * partition.width))
                flat = pa.Array.from_buffers(pa.float32(), n * partition.width, [None, pa.py_buffer(b"".join(values))])
                ends = pa.array(range(0, (n + 1) * partition.width, partition.width), pa.int32())
                places = pa.array(range(partition.place + k, partition.place + k + n), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(ends, flat), places], ["word", "embedding", "place"])


class Held:
    """A stream's bytes from `at` on, of which some PIECE are in memory."""

    def __init__(self, stream, name: str, start: int = 0):
        self.stream, self.name, self.bytes, self.next, self.before = stream, name, b"", 0, start

    @property
    def at(self) -> int:
        return self.before + self.next

    def more(self) -> None:
        got = self.stream.read(PIECE)
        if not got:
            raise ValueError(f"{self.name}: ends within a record")
        self.before += self.next
        self.bytes, self.next = self.bytes[self.next :] + got, 0

    def upto(self, mark: bytes) -> bytes:
        while (end := self.bytes.find(mark, self.next)) < 0:
            self.more()
        out = self.bytes[self.next : end]
        self.next = end + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self.bytes) - self.next < n:
            self.more()
        out = self.bytes[self.next : self.next + n]
        self.next += n
        return out


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kindred_vectors"

    def schema(self) -> str:
        return "word string, embedding array<float>, place long"

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        return VectorWriter(dict(self.options))


class SheetSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kindred_sheets"

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(dict(self.options))


def read_vectors_binary(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(word, embedding, place) of a file of word2vec's binary format or of a folder of them: a line of count and width, then each word, a blank and its little-endian floats.

    options: `records` of a task, `errors` of words that aren't UTF-8 ("strict", "replace", "ignore"). place counts a file's records from 0; a word that comes again gives
    a row again. A file of no records gives no rows, one that ends early or has another first line is an error; what stands behind the last record is not read.
    """
    spark.dataSource.register(VectorSource)
    return spark.read.format("kindred_vectors").options(**options).load(path)


def write_vectors_binary(vectors: DataFrame, path: str, **options: object) -> None:
    """Appends (word, embedding) to a folder of binary files of at most `records` records each. Words that are null, empty or hold a blank or a line's end, and embeddings that are null, empty,
    hold a null or differ in length within a file, are errors. An empty table leaves an empty folder or none."""
    vectors.sparkSession.dataSource.register(VectorSource)
    vectors.selectExpr("cast(word AS string) AS word", "cast(embedding AS array<float>) AS embedding").write.format("kindred_vectors").options(**options).mode("append").save(path)


def write_xlsx(df: DataFrame, path: str, **options: object) -> None:
    """Appends df to a folder of spreadsheets of one sheet, at most `rows` rows (1,048,574 unless given) below a bold header, columns `width` characters wide, the sheet's name `sheet`.

    Cells are text, as Spark casts values; nulls are gaps, rows that repeat stay. A cell of more than 32,767 characters is an error. An empty table leaves no sheet.
    """
    df.sparkSession.dataSource.register(SheetSink)
    df.selectExpr(*(f"cast(`{c.replace('`', '``')}` AS string) AS `{c.replace('`', '``')}`" for c in df.columns)).write.format("kindred_sheets").options(**options).mode("append").save(path)
