"""FITS tables as a Spark data source: ``spark.read.format("fits")`` and ``df.write.format("fits")``.

Reading: the planner reads headers only.  A table's rows are dealt out in ranges
of ``partition_bytes``, so one file is read by many tasks; each decodes the
fields of the schema alone.  A compressed file is one task, as it can't be
entered midway.  Options: ``hdu`` (a number, or a unit's EXTNAME), ``fields``
(names, comma-separated), ``flatten`` (lay vector cells end to end, a row per
element).

Columns are ``row`` (a number from 0, of the element if flattened) and the
fields; scaled integers (TZERO) stay integers, TNULL becomes null.

Writing: a task writes its rows as one part beside the file, and the commit puts
header and parts together in the order of the partitions, copying bytes in
pieces; parts of failed attempts are never looked at.  Rows stand as the frame's
partitions and their order have them.  Mode ``append`` adds a unit to a file
that is there, ``overwrite`` replaces the file.  Options: ``cards`` (JSON list
of [key, value, comment]), ``units`` (JSON list by field), ``repeat`` (elements
a vector cell; a partition's rows must be a multiple), ``rows`` (how many
there must be), ``string_width``.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import shutil
import sys
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Format letters of binary tables.
LETTERS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">f4", "M": ">f8"}
_SPARK = {"L": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "E": T.FloatType(), "D": T.DoubleType(), "C": T.FloatType(), "M": T.DoubleType(), "A": T.StringType()}
_WRITTEN = {T.BooleanType: "L", T.ByteType: "I", T.ShortType: "I", T.IntegerType: "J", T.LongType: "K", T.FloatType: "E", T.DoubleType: "D", T.StringType: "A"}
CARD, BLOCK = 80, 2880
#: Bytes of rows decoded at once.
PIECE = 4 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- files -----------------------------------------------------------------
def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of a local path, and the path in it."""
    return fs.FileSystem.from_uri(path if re.match(r"\w+://", path) else os.path.abspath(path.removeprefix("file:")))


class _Input:
    """A file opened for reading at any place; compressed ones are seen unpacked."""

    def __init__(self, path: str):
        system, at = _system(path)
        self.file = system.open_input_file(at)
        self.packed = self.file.read(2) == b"\x1f\x8b"
        self.file.seek(0)
        if self.packed:
            self.file = gzip.GzipFile(fileobj=self.file)

    def __enter__(self):
        return self.file

    def __exit__(self, *_):
        self.file.close()


# --- headers ---------------------------------------------------------------
@dataclass
class Field:
    name: str
    letter: str
    count: int
    start: int  # of its bytes in a row
    width: int
    scale: float = 1
    zero: float = 0
    null: int | None = None
    unit: str = ""

    @property
    def scaled(self) -> bool:
        return (self.scale, self.zero) != (1, 0)

    @property
    def kind(self) -> T.DataType:
        """Of one element: scaled integers are long if their scale is 1, else double."""
        if self.scaled and self.letter in "BIJK":
            return T.LongType() if self.scale == 1 and self.zero == int(self.zero) else T.DoubleType()
        return _SPARK[self.letter]


@dataclass
class Unit:
    cards: list[tuple[str, object, str]]
    start: int  # of the data
    size: int

    @property
    def header(self) -> dict:
        return {k: v for k, v, _ in self.cards}

    @property
    def ascii(self) -> bool:
        return str(self.header.get("XTENSION", "")).strip() == "TABLE"

    def fields(self) -> list[Field]:
        h, out, at, seen = self.header, [], 0, set()
        for i in range(1, h["TFIELDS"] + 1):
            name = str(h.get(f"TTYPE{i}", "")).strip() or f"COLUMN_{i}"
            while name.lower() in seen or name.lower() == "row":
                name += f"_{i}"
            seen.add(name.lower())
            form, unit = str(h[f"TFORM{i}"]).strip(), str(h.get(f"TUNIT{i}", "")).strip()
            if self.ascii:
                letter, width = re.match(r"([A-Z])(\d+)", form).groups()
                out.append(Field(name, {"A": "A", "I": "K"}.get(letter, "D"), 1, h[f"TBCOL{i}"] - 1, int(width), unit=unit))
                continue
            count, letter = re.match(r"(\d*)([A-Z])", form).groups()
            count = int(count or 1)
            width = count if letter == "A" else -(-count // 8) if letter == "X" else count * np.dtype(LETTERS.get(letter, ">i8")).itemsize * (1 + (letter in "CM"))
            out.append(Field(name, letter, count, at, width, h.get(f"TSCAL{i}", 1), h.get(f"TZERO{i}", 0), h.get(f"TNULL{i}"), unit))
            at += width
        return out


def _card_value(body: str):
    quoted = re.match(r"'((?:[^']|'')*)'", body)
    if quoted:
        return quoted[1].replace("''", "'").rstrip(), body[quoted.end() :].partition("/")[2].strip()
    text, _, comment = body.partition("/")
    text = text.strip()
    value = text == "T" if text in ("T", "F") else None if not text else float(text.replace("D", "E")) if re.search(r"[.DE]", text) else int(text)
    return value, comment.strip()


def units(file) -> list[Unit]:
    """All units of a file, from its headers alone."""
    out, at = [], 0
    while True:
        cards, done = [], False
        while not done:
            file.seek(at)
            block = file.read(BLOCK)
            if len(block) < BLOCK:
                if cards:
                    raise ValueError("the file ends within a header")
                return out
            at += BLOCK
            for k in range(0, BLOCK, CARD):
                card = block[k : k + CARD].decode("ascii", "replace")
                key = card[:8].strip()
                if key == "END":
                    done = True
                    break
                if card[8:10] == "= ":
                    cards.append((key, *_card_value(card[10:].strip())))
                elif key in ("COMMENT", "HISTORY"):
                    cards.append((key, card[8:].strip(), ""))
        h = {k: v for k, v, _ in cards}
        size = abs(h.get("BITPIX", 8)) // 8 if h.get("NAXIS", 0) else 0
        for n in range(1, h.get("NAXIS", 0) + 1):
            size *= h[f"NAXIS{n}"]
        size += h.get("PCOUNT", 0) if h.get("NAXIS", 0) else 0
        out.append(Unit(cards, at, size))
        at += -(-size // BLOCK) * BLOCK


def table_unit(file, hdu: int | str = 1) -> Unit:
    """A table unit by its number or its EXTNAME."""
    found = units(file)
    if str(hdu).lstrip("-").isdigit():
        if not 0 < int(hdu) < len(found):
            raise ValueError(f"no table unit {hdu}: the file has {len(found)} units")
        unit = found[int(hdu)]
    else:
        unit = next((u for u in found if str(u.header.get("EXTNAME", "")).strip().lower() == str(hdu).strip().lower()), None)
        if unit is None:
            raise ValueError(f"no unit is named {hdu}")
    if "TFIELDS" not in unit.header:
        raise ValueError(f"unit {hdu} is no table")
    return unit


def header_of(path: str, hdu: int | str = 1) -> Unit:
    with _Input(path) as file:
        return table_unit(file, hdu)


# --- reading ---------------------------------------------------------------
@dataclass
class _Rows(InputPartition):
    path: str
    first: int
    stop: int


def _elements(field: Field, table: np.ndarray, ascii_table: bool) -> pa.Array:
    """A field's elements, cell by cell, as Arrow values of ``field.kind``."""
    raw = np.ascontiguousarray(table[:, field.start : field.start + field.width])
    if field.letter == "A":
        return pa.array([bytes(r).split(b"\0")[0].decode("ascii", "replace").rstrip() for r in raw], pa.string())
    if ascii_table:
        text = [bytes(r).decode("ascii").strip().replace("D", "E") for r in raw]
        return pa.array([None if not t else int(t) if field.letter == "K" else float(t) for t in text], pa.int64() if field.letter == "K" else pa.float64())
    values = raw.view(LETTERS[field.letter]).reshape(-1)
    if field.letter == "L":
        return pa.array(values == b"T", mask=(values != b"T") & (values != b"F"))
    empty = None if field.null is None else values == field.null
    if field.scaled and field.letter in "BIJK":
        values = values.astype(np.int64) + int(field.zero) if isinstance(field.kind, T.LongType) else values * field.scale + field.zero
    elif field.scaled:
        values = (values * field.scale + field.zero).astype(values.dtype)
    values = values.astype("i2" if field.letter == "B" and not field.scaled else values.dtype.newbyteorder("="))
    return pa.array(values, mask=empty)


class FitsReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.hdu = options["path"], options.get("hdu", "1")
        self.flat = str(options.get("flatten", "false")).lower() == "true"
        self.bytes = int(options.get("partition_bytes", 32 << 20))
        self.names = [f.name for f in schema.fields]

    def _per_cell(self, fields: list[Field]) -> int:
        sizes = {f.count for f in fields if f.letter != "A"} or {1}
        if len(sizes) > 1:
            raise ValueError("fields whose cells have different numbers of elements can't be laid end to end together")
        return sizes.pop()

    def partitions(self):
        with _Input(self.path) as file:
            unit, packed = table_unit(file, self.hdu), isinstance(file, gzip.GzipFile)
        rows, width = unit.header["NAXIS2"], max(1, unit.header["NAXIS1"])
        own = {f.name for f in unit.fields()}
        missing = [n for n in self.names if n != "row" and n not in own]
        if missing:
            raise ValueError(f"no field {missing[0]}")
        step = max(1, rows) if packed else max(1, self.bytes // width)
        return [_Rows(self.path, a, min(rows, a + step)) for a in range(0, max(1, rows), step)]

    def read(self, partition: _Rows):
        with _Input(partition.path) as file:
            unit = table_unit(file, self.hdu)
            width = unit.header["NAXIS1"]
            by_name = {f.name: f for f in unit.fields()}
            fields = [by_name[n] for n in self.names if n != "row"]
            n = self._per_cell(fields) if self.flat else 1
            file.seek(unit.start + partition.first * width)
            step = max(1, PIECE // max(1, width))
            for a in range(partition.first, partition.stop, step):
                rows = min(step, partition.stop - a)
                raw = file.read(rows * width)
                if len(raw) < rows * width:
                    raise ValueError("the file ends within a table")
                table = np.frombuffer(raw, np.uint8).reshape(rows, width)
                columns = []
                for name in self.names:
                    if name == "row":
                        columns.append(pa.array(np.arange(a * n, (a + rows) * n)))
                        continue
                    field = by_name[name]
                    if field.letter not in _SPARK:
                        raise ValueError(f"field {name} has a format that isn't read: {field.letter}")
                    values = _elements(field, table, unit.ascii)
                    per = 1 if field.letter == "A" else field.count * (1 + (field.letter in "CM"))
                    if per != 1 and not self.flat or field.letter in "CM":
                        per = 2 if self.flat else per
                        values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, per), pa.int32()), values)
                    columns.append(values)
                yield pa.RecordBatch.from_arrays(columns, names=self.names)


# --- writing ---------------------------------------------------------------
@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


def _card(key: str, value, comment: str = "") -> bytes:
    if key in ("COMMENT", "HISTORY"):
        return f"{key:<8}{value}".ljust(CARD)[:CARD].encode("ascii", "replace")
    quoted = str(value).replace("'", "''")
    text = f"'{quoted:<8}'" if isinstance(value, str) else "T" if value is True else "F" if value is False else "" if value is None else repr(value).upper() if isinstance(value, float) else str(value)
    text = f"{key[:8]:<8}= {text if isinstance(value, str) else text.rjust(20)}"
    return (f"{text} / {comment}" if comment else text).ljust(CARD)[:CARD].encode("ascii", "replace")


def _block(cards: list) -> bytes:
    raw = b"".join(_card(*c) for c in cards) + b"END".ljust(CARD)
    return raw + b" " * (-len(raw) % BLOCK)


class FitsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.repeat, self.width = int(options.get("repeat", 1)), int(options.get("string_width", 32))
        self.rows = int(options["rows"]) if "rows" in options else None
        self.cards, self.units = json.loads(options.get("cards", "[]")), json.loads(options.get("units", "[]"))
        self.run = uuid.uuid4().hex
        self.fields = []
        for f in schema.fields:
            letter = _WRITTEN.get(type(f.dataType))
            if letter is None or (letter == "A" and self.repeat > 1):
                raise ValueError(f"field {f.name} has a type that isn't written: {f.dataType.simpleString()}")
            self.fields.append((f.name, letter))
        self.dtype = np.dtype([(f"f{i}", f"S{self.width}") if letter == "A" else (f"f{i}", LETTERS[letter], (self.repeat,)) for i, (_, letter) in enumerate(self.fields)])

    def _part_path(self, name: str) -> str:
        folder, _, base = self.path.rpartition("/")
        return f"{folder}/.{base}.{self.run}.{name}" if folder else f".{base}.{self.run}.{name}"

    def _cells(self, batches: list[pa.RecordBatch]) -> bytes:
        table = pa.Table.from_batches(batches)
        out = np.zeros(table.num_rows // self.repeat, self.dtype)
        for i, (name, letter) in enumerate(self.fields):
            column = table.column(i)
            if letter == "A":
                out[f"f{i}"] = [(x or "").encode("ascii", "replace")[: self.width] for x in column.to_pylist()]
                continue
            if column.null_count and letter not in "EDL":
                raise ValueError(f"an integer field has no value for nulls: {name}")
            if letter == "L":
                values = np.array([b"\0" if x is None else b"T" if x else b"F" for x in column.to_pylist()])
            else:
                values = column.to_numpy()
            out[f"f{i}"] = values.reshape(-1, self.repeat)
        return out.tobytes()

    def write(self, iterator) -> _Part:
        context = TaskContext.get()
        partition = context.partitionId()
        path = self._part_path(f"{partition}-{context.taskAttemptId()}")
        system, at = _system(path)
        held, rows = [], 0
        with system.open_output_stream(at) as out:
            for batch in iterator:
                rows += batch.num_rows
                held.append(batch)
                n = sum(b.num_rows for b in held)
                if n >= self.repeat:
                    whole = n - n % self.repeat
                    table = pa.Table.from_batches(held)
                    out.write(self._cells(table.slice(0, whole).to_batches()))
                    held = table.slice(whole).to_batches()
            if sum(b.num_rows for b in held):
                raise ValueError(f"a partition's rows aren't a multiple of {self.repeat}")
        return _Part(partition, path, rows)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        rows = sum(m.rows for m in parts)
        try:
            if self.rows is not None and rows != self.rows:
                raise ValueError(f"{rows} rows where there must be {self.rows}")
            self._joined(parts, rows)
        finally:
            self._removed(parts)

    def _joined(self, parts: list[_Part], rows: int) -> None:
        cards = [["XTENSION", "BINTABLE"], ["BITPIX", 8], ["NAXIS", 2], ["NAXIS1", self.dtype.itemsize], ["NAXIS2", rows // self.repeat], ["PCOUNT", 0], ["GCOUNT", 1], ["TFIELDS", len(self.fields)]]
        for i, (name, letter) in enumerate(self.fields, 1):
            count = self.width if letter == "A" else self.repeat
            cards += [[f"TTYPE{i}", name], [f"TFORM{i}", f"{count if count > 1 else ''}{letter}"]]
            if i <= len(self.units) and self.units[i - 1]:
                cards.append([f"TUNIT{i}", self.units[i - 1]])
        system, at = _system(self.path)
        there = system.get_file_info(at).type != fs.FileType.NotFound
        whole = self._part_path("whole")
        _, beside = _system(whole)
        with system.open_output_stream(beside) as plain:
            out = gzip.GzipFile(fileobj=plain, mode="wb", mtime=0) if self.path.endswith(".gz") else plain
            if there and not self.overwrite:
                with _Input(self.path) as old:
                    shutil.copyfileobj(old, out, PIECE)
            else:
                out.write(_block([["SIMPLE", True], ["BITPIX", 8], ["NAXIS", 0], ["EXTEND", True]]))
            out.write(_block(cards + self.cards))
            for part in parts:
                with system.open_input_stream(_system(part.path)[1]) as own:
                    shutil.copyfileobj(own, out, PIECE)
            out.write(b"\0" * (-(rows // self.repeat * self.dtype.itemsize) % BLOCK))
            if out is not plain:
                out.close()
        system.move(beside, at)

    def abort(self, messages) -> None:
        self._removed([m for m in messages if m])

    def _removed(self, parts: list[_Part]) -> None:
        for part in parts:
            system, at = _system(part.path)
            if system.get_file_info(at).type != fs.FileType.NotFound:
                system.delete_file(at)


class FitsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> T.StructType:
        unit = header_of(self.options["path"], self.options.get("hdu", "1"))
        fields = unit.fields()
        if self.options.get("fields"):
            names, by_name = [n.strip() for n in self.options["fields"].split(",")], {f.name: f for f in fields}
            missing = [n for n in names if n not in by_name]
            if missing:
                raise ValueError(f"no field {missing[0]}")
            fields = [by_name[n] for n in names]
        flat = str(self.options.get("flatten", "false")).lower() == "true"
        out = [T.StructField("row", T.LongType())]
        for f in fields:
            kind = f.kind if f.letter in _SPARK else T.NullType()
            cell = T.ArrayType(kind) if f.letter in "CM" or (f.count != 1 and f.letter != "A" and not flat) else kind
            out.append(T.StructField(f.name, cell))
        return T.StructType(out)

    def reader(self, schema: T.StructType) -> FitsReader:
        return FitsReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(dict(self.options), schema, overwrite)
