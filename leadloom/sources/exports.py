"""Files written by tasks: workbooks, CSV and JSON of ordered rows, and images, through a Spark data source with a commit.

A task writes its rows to files of its own below ``_temporary``; only when all tasks have ended well are those files moved to
their names, in the order of the parts, and a manifest says what was written.  What a task that failed or was repeated has left
goes with the temporary folder, so an export is there as a whole or not at all.  Folders are reached by ``pyarrow.fs``
(files, HDFS, S3, GCS), on executors as on the driver.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice
from typing import Any
from xml.sax.saxutils import escape

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import ship

FORMAT = "leadloom_export"
#: Rows of a sheet, its header included (fixed value of the format).
SHEET_ROWS = 1_048_576
TEMPORARY, MANIFESTS = "_temporary", "_manifests"


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder, and the folder in it. Paths without a scheme are local."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def xlsx(out, columns: list[str], rows: Iterator) -> int:
    """A workbook with one sheet "Leads", written row by row; the header is bold and white on dark blue. Returns the number of rows."""
    sheet, n = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", 0
    rel, doc = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda v, s="": f'<c t="inlineStr"{s}><is><t xml:space="preserve">{escape("".join(x for x in ("" if v is None else str(v)) if x >= " " or x in chr(9) + chr(10)))}</t></is></c>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in (("/xl/workbook.xml", "sheet.main"), ("/xl/worksheets/sheet1.xml", "worksheet"), ("/xl/styles.xml", "styles")))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{rel}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rel}/relationships"><Relationship Id="r1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{sheet}" xmlns:r="{doc}"><sheets><sheet name="Leads" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}/relationships"><Relationship Id="r1" Type="{doc}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{doc}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{sheet}"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF0A1F44"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{sheet}"><cols><col min="1" max="{len(columns)}" width="22" customWidth="1"/></cols><sheetData><row>'.encode())
            f.write("".join(cell(c, ' s="1"') for c in columns).encode() + b"</row>")
            for row in rows:
                f.write(f"<row>{''.join(cell(v) for v in row)}</row>".encode())
                n += 1
            f.write(b"</sheetData></worksheet>")
    return n


def csv_file(out, columns: list[str], rows: Iterator) -> int:
    """A header and the rows, with quotes where a value needs them; nulls are empty."""
    text, n = io.TextIOWrapper(out, "utf-8", newline=""), 0
    sheet = csv.writer(text, lineterminator="\n")
    sheet.writerow(columns)
    for row in rows:
        sheet.writerow(["" if v is None else v for v in row])
        n += 1
    text.flush()
    text.detach()
    return n


def json_file(out, columns: list[str], rows: Iterator) -> int:
    """One array of objects, indented by two spaces."""
    n = 0
    for row in rows:
        shown = json.dumps(dict(zip(columns, row, strict=True)), ensure_ascii=False, indent=2, default=str).replace("\n", "\n  ")
        out.write((("[\n  " if not n else ",\n  ") + shown).encode())
        n += 1
    out.write(b"\n]" if n else b"[]")
    return n


KINDS: dict[str, Callable[[Any, list[str], Iterator], int]] = {"csv": csv_file, "json": json_file, "xlsx": xlsx}


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, in order, with their rows."""

    part: int
    files: list[tuple[str, int]]


class FilesWriter(DataSourceWriter):
    """Writes files of ``kind``, at most ``rows`` rows each."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.folder, self.name, self.kind, self.columns = options["folder"].rstrip("/"), options["name"], options["kind"], columns
        self.rows = int(options.get("rows", SHEET_ROWS - 1))

    @property
    def temporary(self) -> str:
        return posixpath.join(filesystem(self.folder)[1], TEMPORARY, f"{self.name}.{self.kind}")

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, fs, files = task.partitionId() if task else 0, filesystem(self.folder)[0], []
        fs.create_dir(self.temporary, recursive=True)
        rows = iter(iterator)
        while (first := next(rows, None)) is not None:
            at = posixpath.join(self.temporary, f"{part}-{len(files)}-{uuid.uuid4().hex}")
            with fs.open_output_stream(at) as out:
                n = KINDS[self.kind](out, self.columns, islice(chain([first], rows), self.rows))
            files.append((at, n))
        return Written(part, files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.folder)
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        if not files:  # an export without rows is a file, too
            fs.create_dir(self.temporary, recursive=True)
            with fs.open_output_stream(empty := posixpath.join(self.temporary, "empty")) as out:
                KINDS[self.kind](out, self.columns, iter(()))
            files = [(empty, 0)]
        if len(files) == 1:
            path, names = f"{self.name}.{self.kind}", [f"{self.name}.{self.kind}"]
        else:
            path = f"{self.name}.{self.kind}.d"
            names = [f"{path}/{k:05d}.{self.kind}" for k in range(1, len(files) + 1)]
            fs.create_dir(posixpath.join(root, path), recursive=True)
        for (at, _), name in zip(files, names, strict=True):
            to = posixpath.join(root, name)
            if fs.get_file_info(to).type != pyarrow.fs.FileType.NotFound:
                raise FileExistsError(f"{to} exists")
            fs.move(at, to)
        fs.create_dir(posixpath.join(root, MANIFESTS), recursive=True)
        with fs.open_output_stream(posixpath.join(root, MANIFESTS, f"{self.name}.{self.kind}.json")) as out:
            out.write(json.dumps({"path": path, "rows": sum(n for _, n in files), "files": [{"name": n, "rows": f[1]} for n, f in zip(names, files, strict=True)]}).encode())
        fs.delete_dir(self.temporary)

    def abort(self, messages: list[Written | None]) -> None:
        fs = filesystem(self.folder)[0]
        if fs.get_file_info(self.temporary).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(self.temporary)


class ImagesWriter(DataSourceWriter):
    """Writes each row (name, content) to a file of that name; a name that is there already gets the same content again."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.folder, self.name, self.kind = options["folder"].rstrip("/"), options["name"], options["kind"]

    @property
    def temporary(self) -> str:
        return posixpath.join(filesystem(self.folder)[1], TEMPORARY, f"{self.name}.{self.kind}")

    def write(self, iterator: Iterator) -> Written:
        fs, root = filesystem(self.folder)
        fs.create_dir(self.temporary, recursive=True)
        n = 0
        for name, content in iterator:
            if name and content is not None and "/" not in name:
                at = posixpath.join(self.temporary, uuid.uuid4().hex)
                with fs.open_output_stream(at) as out:
                    out.write(bytes(content))
                fs.move(at, posixpath.join(root, name))  # whole or not at all
                n += 1
        return Written(0, [("", n)])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.folder)
        fs.create_dir(posixpath.join(root, MANIFESTS), recursive=True)
        with fs.open_output_stream(posixpath.join(root, MANIFESTS, f"{self.name}.{self.kind}.json")) as out:
            out.write(json.dumps({"path": "", "rows": sum(n for m in messages if m for _, n in m.files), "files": []}).encode())
        self.abort(messages)

    abort = FilesWriter.abort


class Export(DataSource):
    """``spark.read``'s counterpart for exports: options ``folder``, ``name``, ``kind`` (csv, json, xlsx or images) and ``rows``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        options = dict(self.options)
        return (ImagesWriter if options["kind"] == "images" else FilesWriter)(options, schema.names)


def save(df, folder: str, name: str, kind: str, rows: int = SHEET_ROWS - 1) -> dict:
    """Writes ``df`` in its order and returns the manifest: path (below ``folder``), rows, and files."""
    spark: SparkSession = ship(df.sparkSession)
    if kind not in KINDS and kind != "images":
        raise ValueError(f"Unsupported export format: {kind.upper()}")
    fs, root = filesystem(folder.rstrip("/"))
    if fs.get_file_info(posixpath.join(root, MANIFESTS, f"{name}.{kind}.json")).type != pyarrow.fs.FileType.NotFound and kind != "images":
        raise FileExistsError(f"{folder}/{name}.{kind} exists")
    spark.dataSource.register(Export)
    df.write.format(FORMAT).mode("append").options(folder=folder, name=name, kind=kind, rows=str(rows)).save()
    with fs.open_input_stream(posixpath.join(root, MANIFESTS, f"{name}.{kind}.json")) as f:
        return json.loads(f.read())
