"""Binary tables of FITS files as a Spark data source.

``spark.read.format("fits_tables").option("hdu", "R,I,Z").load(folder)`` reads the named tables of
every file side by side, row by row: columns ``PARAM_BAND``, plus ``tile`` (file name) and
``ide`` (row number). A single ``hdu`` gives plain column names. The driver only lists files and
opens one for the schema; headers and rows are read in the tasks, in slices of large files, and
only the columns of the schema are decoded. Columns of variable length (descriptors into the heap) are arrays;
their part of the heap is read in pieces of bounded size.

Options: ``hdu`` (names or numbers, default 1), ``columns`` (comma-separated parameters),
``incomplete`` (``skip`` leaves out files that lack a table or column, ``fail`` raises),
``splitbytes`` (bytes of files per task).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import (
    ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType,
    ShortType, StringType, StructField, StructType,
)

# Sizes of the file format.
BLOCK, CARD = 2880, 80
#: Bytes of all tables' rows that are read at once.
BATCH_BYTES = 32 << 20

# Type codes of the file format -> numpy type and Spark type.
TYPES: dict[str, tuple[str, DataType]] = {
    "L": ("u1", BooleanType()),
    "B": ("u1", ShortType()),
    "I": (">i2", ShortType()),
    "J": (">i4", IntegerType()),
    "K": (">i8", LongType()),
    "E": (">f4", FloatType()),
    "D": (">f8", DoubleType()),
    "A": ("S", StringType()),
}


#: Descriptors of values in the heap: how many there are, and where they start.
DESCRIPTORS = {"P": ">i4", "Q": ">i8"}
#: Pieces of the heap no farther apart than this are read at once.
GAP_BYTES = 1 << 16


@dataclass(frozen=True)
class Column:
    name: str
    code: str
    repeat: int
    shape: tuple[int, ...]
    offset: int
    width: int
    scale: float
    zero: float
    null: int | None
    #: Type of the descriptor if the values lie in the heap.
    descriptor: str | None = None

    def spark_type(self) -> DataType:
        base = TYPES[self.code][1]
        if self.code == "A":
            return base
        if self.descriptor:
            return ArrayType(self.element().spark_type())
        if self.scale != 1.0 or self.zero != 0.0:
            base = DoubleType()
        for _ in self.shape:
            base = ArrayType(base)
        return base


    def element(self) -> Column:
        """One value of a column of variable length."""
        return replace(self, repeat=1, shape=(), offset=0, width=np.dtype(TYPES[self.code][0]).itemsize or 1, descriptor=None)


@dataclass(frozen=True)
class Table:
    name: str
    number: int
    start: int
    row_bytes: int
    rows: int
    columns: dict[str, Column]
    #: Columns of a type that is not read.
    unreadable: tuple[str, ...] = ()
    #: Place and size of the heap, where values of variable length lie.
    heap: int = 0
    heap_bytes: int = 0


class Incomplete(ValueError):
    """A file lacks a wanted table or column."""


def _header(stream) -> dict | None:
    cards: dict = {}
    while True:
        block = stream.read(BLOCK)
        if not block:
            return None
        if len(block) < BLOCK:
            raise ValueError("truncated header")
        for i in range(0, BLOCK, CARD):
            card = block[i:i + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] == "= ":
                cards[key] = _value(card[10:])


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        quoted = re.match(r"'((?:[^']|'')*)'", text)
        return quoted.group(1).replace("''", "'").rstrip() if quoted else text
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def tables_of(stream) -> list[Table]:
    """Binary tables of one open file; reads headers and skips data."""
    found, number = [], 0
    while (cards := _header(stream)) is not None:
        axes = [cards.get(f"NAXIS{i + 1}", 0) for i in range(cards.get("NAXIS", 0))]
        size = math.prod(axes) * abs(cards.get("BITPIX", 8)) // 8 if axes else 0
        size = (size + cards.get("PCOUNT", 0)) * cards.get("GCOUNT", 1)
        start = stream.tell()
        if cards.get("XTENSION") == "BINTABLE":
            data = axes[0] * axes[1]
            heap = cards.get("THEAP", data)
            found.append(Table(str(cards.get("EXTNAME", number)), number, start, axes[0], axes[1], _columns(cards),
                               _unreadable(cards), start + heap, data + cards.get("PCOUNT", 0) - heap))
        stream.seek(start + math.ceil(size / BLOCK) * BLOCK)
        number += 1
    return found


def _form(text: str) -> tuple[int, str | None, str]:
    """Repeat count, descriptor of the heap if any, and type code."""
    repeat, descriptor, code = re.match(r"(\d*)([PQ]?)([A-Z])", text).groups()
    return int(repeat) if repeat else 1, descriptor or None, code


def _columns(cards: dict) -> dict[str, Column]:
    columns, offset = {}, 0
    for i in range(1, cards.get("TFIELDS", 0) + 1):
        repeat, descriptor, code = _form(cards[f"TFORM{i}"])
        unit = {"C": 8, "M": 16, "A": 1, "X": 0}.get(code)
        if descriptor:
            unit = np.dtype(DESCRIPTORS[descriptor]).itemsize * 2
        elif unit is None:
            unit = np.dtype(TYPES[code][0]).itemsize
        width = math.ceil(repeat / 8) if code == "X" and not descriptor else unit * repeat
        name = str(cards.get(f"TTYPE{i}", f"col{i}"))
        dims = re.findall(r"\d+", str(cards.get(f"TDIM{i}", "")))
        # dimensions are stored fastest first
        shape = tuple(int(d) for d in reversed(dims)) if dims else ((repeat,) if repeat != 1 else ())
        if code in TYPES:
            columns[name] = Column(
                name, code, repeat, () if code == "A" or descriptor else shape, offset, width,
                float(cards.get(f"TSCAL{i}", 1.0)), float(cards.get(f"TZERO{i}", 0.0)), cards.get(f"TNULL{i}"),
                descriptor,
            )
        offset += width
    return columns


def _unreadable(cards: dict) -> tuple[str, ...]:
    return tuple(
        str(cards.get(f"TTYPE{i}", f"col{i}")) for i in range(1, cards.get("TFIELDS", 0) + 1)
        if _form(cards[f"TFORM{i}"])[2] not in TYPES)


def pick_tables(tables: list[Table], hdus: list[str], wanted: list[str] | None) -> list[Table]:
    picked = []
    for hdu in hdus:
        match = [t for t in tables if t.name == hdu or str(t.number) == hdu]
        if not match:
            raise Incomplete(f"no table {hdu}")
        unreadable = [c for c in wanted or match[0].unreadable if c in match[0].unreadable]
        if unreadable:
            raise ValueError(f"table {hdu}: the type of {unreadable} cannot be read; name the columns you want")
        missing = [c for c in wanted or [] if c not in match[0].columns]
        if missing:
            raise Incomplete(f"table {hdu} lacks {missing}")
        picked.append(match[0])
    if len({t.rows for t in picked}) > 1:
        raise Incomplete(f"tables {hdus} differ in length")
    return picked


def decode(raw: np.ndarray, column: Column) -> np.ndarray:
    """Column values of a block of rows given as bytes, shape (rows, row_bytes)."""
    data = np.ascontiguousarray(raw[:, column.offset:column.offset + column.width])
    if column.code == "A":
        return np.char.rstrip(np.char.decode(data.view(f"S{column.width}").ravel(), "ascii", "replace"))
    values = data.view(TYPES[column.code][0])
    values = values.reshape((len(raw),) + column.shape) if column.shape else values.ravel()
    if column.code == "L":
        true = values == ord("T")
        return np.ma.masked_array(true, mask=values == 0) if (values == 0).any() else true
    blank = values == column.null if column.null is not None else None
    if column.scale != 1.0 or column.zero != 0.0:
        values = values.astype("f8") * column.scale + column.zero
    elif column.code == "B":
        values = values.astype("i2")
    else:
        values = values.astype(values.dtype.newbyteorder("="))
    if blank is not None and blank.any():
        return np.ma.masked_array(values, mask=blank)
    return values


def descriptors(raw: np.ndarray, column: Column) -> tuple[np.ndarray, np.ndarray]:
    """Number of values and place in the heap, row by row."""
    if not column.width:
        return np.zeros(len(raw), "i8"), np.zeros(len(raw), "i8")
    data = np.ascontiguousarray(raw[:, column.offset:column.offset + column.width])
    pairs = data.view(DESCRIPTORS[column.descriptor]).reshape(len(raw), 2).astype("i8")
    return pairs[:, 0], pairs[:, 1]


def decode_heap(raw: np.ndarray, column: Column, table: Table, stream) -> pa.Array:
    """A column of variable length: arrays, or text."""
    many, at = descriptors(raw, column)
    one = column.element()
    size = many * one.width
    if len(raw) and ((many < 0) | (many > 0) & ((at < 0) | (at + size > table.heap_bytes))).any():
        raise ValueError(f"table {table.name}: {column.name} points outside the heap")
    pieces: list[bytes] = [b""] * len(raw)
    block, start = b"", 0
    order = [int(k) for k in np.argsort(at, kind="stable") if size[k]]
    for n, k in enumerate(order):
        if not start <= at[k] or at[k] + size[k] > start + len(block):
            start, stop = int(at[k]), int(at[k] + size[k])
            for j in order[n + 1:]:
                if at[j] > stop + GAP_BYTES or at[j] + size[j] - start > BATCH_BYTES:
                    break
                stop = max(stop, int(at[j] + size[j]))
            stream.seek(table.heap + start)
            block = stream.read(stop - start)
            if len(block) < stop - start:
                raise ValueError(f"table {table.name}: truncated heap")
        pieces[k] = block[at[k] - start:at[k] - start + size[k]]
    if column.code == "A":
        return pa.array([p.split(b"\0")[0].decode("ascii", "replace").rstrip() for p in pieces], pa.string())
    values = decode(np.frombuffer(b"".join(pieces), "u1").reshape(-1, one.width), one)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), _arrow(values, one.spark_type()))


def _arrow(values: np.ndarray, kind: DataType) -> pa.Array:
    if isinstance(values, np.ma.MaskedArray):
        if values.ndim > 1:
            return pa.array(values.tolist())
        return pa.array(values.data, mask=values.mask)
    if values.ndim == 1:
        return pa.array(values.tolist() if values.dtype.kind == "U" else values)
    array = pa.array(values.reshape(-1))
    for size in reversed(values.shape[1:]):
        array = pa.ListArray.from_arrays(pa.array(np.arange(0, len(array) + 1, size), pa.int32()), array)
    return array


@dataclass
class Slices(InputPartition):
    """File slices of one task: (path, slice number, slice count)."""

    parts: tuple[tuple[str, int, int], ...]

    def __init__(self, parts):
        self.parts = parts


class FitsTables(DataSource):
    @classmethod
    def name(cls):
        return "fits_tables"

    def schema(self):
        settings = _Settings(self.options)
        for path, _ in settings.files():
            with settings.fs.open_input_file(path) as stream:
                try:
                    picked = pick_tables(tables_of(stream), settings.hdus, settings.wanted)
                except Incomplete:
                    if settings.skip:
                        continue
                    raise
            fields = [StructField("tile", StringType()), StructField("ide", LongType())]
            for hdu, table in zip(settings.hdus, picked):
                for name in settings.wanted or table.columns:
                    fields.append(StructField(settings.output(name, hdu), table.columns[name].spark_type()))
            return StructType(fields)
        raise ValueError(f"no file with the tables {settings.hdus}")

    def reader(self, schema):
        return FitsReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("files are added to a folder; write to a new one")
        from skylattice.sources.fits_write import FitsWriter

        return FitsWriter(dict(self.options), schema)


class _Settings:
    def __init__(self, options):
        self.options = options
        self.hdus = [h.strip() for h in str(options.get("hdu", "1")).split(",")]
        wanted = options.get("columns")
        self.wanted = [c.strip() for c in wanted.split(",")] if wanted else None
        self.skip = options.get("incomplete", "skip") == "skip"
        self.split_bytes = int(options.get("splitbytes", 128 * 1024 * 1024))
        path = options["path"]
        if "://" in path or path.startswith("file:"):
            self.fs, self.root = pafs.FileSystem.from_uri(path)
        else:
            self.fs, self.root = pafs.LocalFileSystem(), path
        self.inner = self.root

    def output(self, name: str, hdu: str) -> str:
        return name if len(self.hdus) == 1 else f"{name}_{hdu}"

    def files(self) -> list[tuple[str, int]]:
        info = self.fs.get_file_info(self.root)
        if info.type == pafs.FileType.File:
            return [(info.path, info.size)]
        listing = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True))
        return sorted((f.path, f.size) for f in listing if f.type == pafs.FileType.File and f.path.endswith(".fits"))


class FitsReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options = options
        self.schema = schema

    def partitions(self):
        settings = _Settings(self.options)
        tasks, current, filled = [], [], 0
        for path, size in settings.files():
            count = max(1, math.ceil(size / settings.split_bytes))
            for k in range(count):
                if current and filled + size / count > settings.split_bytes:
                    tasks.append(Slices(tuple(current)))
                    current, filled = [], 0
                current.append((path, k, count))
                filled += size / count
        if current:
            tasks.append(Slices(tuple(current)))
        return tasks

    def read(self, partition):
        settings = _Settings(self.options)
        for path, k, count in partition.parts:
            with settings.fs.open_input_file(path) as stream:
                try:
                    picked = pick_tables(tables_of(stream), settings.hdus, settings.wanted)
                    self._check(settings, picked)
                except Incomplete:
                    if settings.skip:
                        continue
                    raise
                rows = picked[0].rows
                yield from self._slice(settings, stream, path, picked, rows * k // count, rows * (k + 1) // count)

    def _check(self, settings, picked):
        known = {settings.output(n, h) for h, t in zip(settings.hdus, picked) for n in t.columns}
        lacking = [f.name for f in self.schema.fields if f.name not in known | {"tile", "ide"}]
        if lacking:
            raise Incomplete(f"no columns {lacking}")

    def _slice(self, settings, stream, path, picked, first, last):
        # files of one name in two folders are two tiles
        tile = path.removeprefix(settings.inner.rstrip("/") + "/") if path != settings.inner else path.rsplit("/", 1)[-1]
        step = max(1, BATCH_BYTES // max(1, sum(t.row_bytes for t in picked)))
        wanted = [(settings.output(name, hdu), table, column) for hdu, table in zip(settings.hdus, picked)
                  for name, column in table.columns.items() if settings.output(name, hdu) in self.schema.fieldNames()]
        for start in range(first, last, step):
            stop = min(start + step, last)
            rows = {}
            for table in picked:
                stream.seek(table.start + start * table.row_bytes)
                raw = np.frombuffer(stream.read((stop - start) * table.row_bytes), "u1").reshape(-1, table.row_bytes)
                rows[table.number] = raw
            far = sum((descriptors(rows[t.number], c)[0] * c.element().width for _, t, c in wanted if c.descriptor), np.zeros(stop - start, "i8"))
            part = np.cumsum(far) // BATCH_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), stop - start]
            for low, high in zip(edges, edges[1:]):
                values = {"tile": pa.array([tile] * (high - low)), "ide": pa.array(np.arange(start + low, start + high))}
                for out, table, column in wanted:
                    raw = rows[table.number][low:high]
                    values[out] = decode_heap(raw, column, table, stream) if column.descriptor else \
                        _arrow(decode(raw, column), self.schema[out].dataType)
                yield pa.RecordBatch.from_arrays(
                    [values[f.name] for f in self.schema.fields], names=self.schema.fieldNames()
                )


def read_fits(spark, path: str, hdu: str = "1", columns: str | None = None, **options):
    """Tables of all files below ``path``; see the module text for the options."""
    spark.dataSource.register(FitsTables)
    reader = spark.read.format("fits_tables").option("hdu", hdu)
    if columns:
        reader = reader.option("columns", columns)
    return reader.options(**options).load(path)


def write_fits(df, path: str, hdu: str = "1", **options) -> None:
    """Add the rows to the folder ``path`` as files with one table named ``hdu``; see :mod:`skylattice.sources.fits_write`."""
    df.sparkSession.dataSource.register(FitsTables)
    df.write.format("fits_tables").option("hdu", hdu).options(**options).mode("append").save(path)
