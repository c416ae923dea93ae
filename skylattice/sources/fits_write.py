"""Binary tables written as FITS files by Spark tasks.

Each task gathers rows up to ``filebytes`` (64 MiB by default) and writes them as one file: rows first, then
the heap with the values of variable length. Files appear under their final name when the whole job has ended;
what failed or repeated attempts wrote keeps a name that no reader lists, and is removed where it is known.

Numbers, truth values, text and arrays of numbers are written. A missing whole number is the least one of its type,
which may then not occur itself; a missing floating number is NaN; a missing text or array is empty;
a missing truth value stays missing. Text is ASCII without trailing blanks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType,
)

from skylattice.sources.fits import BLOCK, CARD, DESCRIPTORS, TYPES, _Settings

FILE_BYTES = 64 << 20
#: Largest heap whose places a short descriptor can tell.
_SHORT = (1 << 31) - 1
CODES = {BooleanType: "L", ShortType: "I", IntegerType: "J", LongType: "K", FloatType: "E", DoubleType: "D", StringType: "A"}


def type_code(kind: DataType) -> tuple[str, bool]:
    """Type code, and whether the values lie in the heap."""
    inner = kind.elementType if isinstance(kind, ArrayType) else kind
    code = CODES.get(type(inner))
    if code is None or (isinstance(kind, ArrayType) and code in "LA"):
        raise ValueError(f"{kind.simpleString()} cannot be written")
    return code, isinstance(kind, ArrayType) or code == "A"


def encode(values: pa.Array, code: str, name: str) -> np.ndarray:
    """Values as they stand in the file, one after the other."""
    if code == "L":
        marks = np.where(np.asarray(pc.fill_null(values, False).to_numpy(zero_copy_only=False), bool), ord("T"), ord("F"))
        return np.where(np.asarray(values.is_null()), 0, marks).astype("u1")
    if code in "ED":
        return np.asarray(pc.fill_null(values, math.nan).to_numpy(zero_copy_only=False)).astype(TYPES[code][0])
    least = np.iinfo(np.dtype(TYPES[code][0])).min
    if values.null_count and pc.any(pc.equal(values, pa.scalar(least, values.type))).as_py():
        raise ValueError(f"{name} holds {least}, which stands for a missing value")
    return np.asarray(pc.fill_null(values, pa.scalar(least, values.type)).to_numpy(zero_copy_only=False)).astype(TYPES[code][0])


def _card(key: str, value) -> bytes:
    if isinstance(value, str):
        text = "'" + value.replace("'", "''").ljust(8) + "'"
    else:
        text = f"{'T' if value is True else value:>20}"
    line = f"{key:<8}= {text}".ljust(CARD).encode("ascii")
    if len(line) > CARD:
        raise ValueError(f"{value!r} is too long for a header")
    return line


def _filled(raw: bytes, by: bytes) -> bytes:
    return raw.ljust(math.ceil(len(raw) / BLOCK) * BLOCK, by)


def file_bytes(table: pa.Table, schema: StructType, hdu: str) -> bytes:
    """One file with one table."""
    columns, heap, at = [], [], 0
    for field in schema.fields:
        code, far = type_code(field.dataType)
        values = table.column(field.name).combine_chunks()
        if isinstance(values, pa.ChunkedArray):
            values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
        if not far:
            columns.append((field.name, code, encode(values, code, field.name)))
            continue
        if code == "A":
            pieces = [v.encode("ascii") for v in pc.fill_null(values, "").to_pylist()]
            many, raw = np.array([len(p) for p in pieces], "i8"), b"".join(pieces)
            size = 1
        else:
            many = np.asarray(pc.fill_null(pc.list_value_length(values), 0)).astype("i8")
            flat = encode(values.flatten(), code, field.name)
            raw, size = flat.tobytes(), flat.dtype.itemsize
        places = at + (np.cumsum(many) - many) * size
        columns.append((field.name, code, np.stack([many, places], 1)))
        heap.append(raw)
        at += len(raw)
    form = "P" if at <= _SHORT else "Q"
    cards, parts = [], []
    for i, (name, code, values) in enumerate(columns, 1):
        far = values.ndim == 2
        if far:
            values = values.astype(DESCRIPTORS[form])
        cards += [_card(f"TTYPE{i}", name), _card(f"TFORM{i}", f"1{form}{code}({values[:, 0].max(initial=0)})" if far else f"1{code}")]
        if code in "IJK":
            cards.append(_card(f"TNULL{i}", int(np.iinfo(np.dtype(TYPES[code][0])).min)))
        parts.append(np.ascontiguousarray(values).view("u1").reshape(table.num_rows, -1))
    rows = np.hstack(parts)
    top = [_card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", rows.shape[1]),
           _card("NAXIS2", len(rows)), _card("PCOUNT", at), _card("GCOUNT", 1), _card("TFIELDS", len(columns)), _card("EXTNAME", hdu)]
    primary = [_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0)]
    end = b"END".ljust(CARD)
    return _filled(b"".join(primary) + end, b" ") + _filled(b"".join(top + cards) + end, b" ") + _filled(rows.tobytes() + b"".join(heap), b"\0")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FitsWriter(DataSourceArrowWriter):
    def __init__(self, options, schema):
        for field in schema.fields:
            type_code(field.dataType)
        self.options, self.schema = options, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        settings = _Settings(self.options)
        limit = int(self.options.get("filebytes", FILE_BYTES))
        settings.fs.create_dir(settings.root)
        names, held, size = [], [], 0

        def flush() -> None:
            nonlocal size
            name = f"part-{uuid.uuid4().hex}.fits"
            with settings.fs.open_output_stream(f"{settings.root}/{name}.open") as out:
                out.write(file_bytes(pa.Table.from_batches(held), self.schema, settings.hdus[0]))
            names.append(name)
            held.clear()
            size = 0

        for batch in iterator:
            step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
            for low in range(0, batch.num_rows, step):
                held.append(batch.slice(low, step))
                size += held[-1].nbytes
                if size >= limit:
                    flush()
        if held:
            flush()
        return Written(names)

    def commit(self, messages) -> None:
        settings = _Settings(self.options)
        for name in (n for m in messages if m for n in m.names):
            settings.fs.move(f"{settings.root}/{name}.open", f"{settings.root}/{name}")

    def abort(self, messages) -> None:
        settings = _Settings(self.options)
        for name in (n for m in messages if m for n in m.names):
            settings.fs.delete_file(f"{settings.root}/{name}.open")
