"""Repeated lines or paragraphs: digests of normalised units, grouped over the whole corpus.

A unit is a line (or, with another ``separator``, a paragraph). It is normalised by folding runs of space
and tab to one space, trimming spaces and lower-casing A-Z. Of the units with one digest the earliest
stays, by id and place in the text; the others are removed, and their offsets in the original text kept.

Units without visible content stay; with ``least`` so do units whose normal form is shorter than so many bytes. Defined results: a null text has no bytes and no units;
an empty text has one empty unit;
rows that repeat an id are told apart by a digest of the text, so repeated rows are one document; rows with
a null id are left out; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.llm.common import small_batches

def normalised(unit: Column) -> Column:
    plain = F.trim(F.regexp_replace(unit, r"[ \t]+", " "))
    return F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def units(docs: DataFrame, separator: str = "\n", least: int = 0) -> DataFrame:
    """``id, row, unit_no, digest`` of each unit of at least ``least`` bytes; with 0, of each with visible content."""
    cut = docs.where("id IS NOT NULL").select(
        "id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", F.lit(separator))).alias("unit_no", "unit"))
    return cut.select("id", "row", "unit_no", normalised(F.col("unit")).alias("normal")).where(
        F.octet_length("normal") >= least if least else F.col("normal").rlike(r"[^\x09-\x0D\x20]")).select("id", "row", "unit_no", F.unhex(F.md5("normal")).alias("digest"))


def repeated(docs: DataFrame, separator: str = "\n", least: int = 0) -> DataFrame:
    """``id, row, gone`` with the numbers of the units that an earlier one has, for each document that has any."""
    found = units(docs, separator, least)
    place = F.struct("id", "row", "unit_no")
    # Summed before the exchange: a line of half the corpus is one row from each task.
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = found.join(first, "digest").where(place != F.col("first"))
    return later.groupBy("id", "row").agg(F.collect_set("unit_no").alias("gone"))


def cut(docs: DataFrame, separator: str = "\n", least: int = 0) -> DataFrame:
    """``id, n_bytes, n_units, n_removed, n_removed_bytes, kept_sha256, removed, kept`` per row of ``docs (id, text)``.

    ``removed`` holds ``unit_no, start, length`` in bytes of the original text for each unit taken out,
    ``kept`` the other units with the separator between them.
    """
    small_batches(docs.sparkSession)
    mark = separator.encode()
    span = pa.list_(pa.struct([("unit_no", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2)):
                parts = text.split(mark) if text is not None else []
                off = np.sort(gone.values.to_numpy()) if gone.is_valid else np.empty(0, np.int64)
                length = np.fromiter(map(len, parts), np.int64, len(parts))
                start = np.cumsum(length + len(mark)) - length - len(mark)
                if len(off):
                    stays = np.ones(len(parts), bool)
                    stays[off] = False
                    kept = mark.join([parts[i] for i in np.flatnonzero(stays)])
                else:
                    kept = text or b""
                for column, value in zip(out, (
                        len(text or b""), len(parts), len(off), int(length[off].sum()), hashlib.sha256(kept).hexdigest(),
                        [{"unit_no": int(i), "start": int(start[i]), "length": int(length[i])} for i in off], kept)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))],
                                             ["id", "n_bytes", "n_units", "n_removed", "n_removed_bytes", "kept_sha256", "removed", "kept"])

    rows = docs.where("id IS NOT NULL").select("id", "text", F.xxhash64("text").alias("row"))
    number = docs.schema["id"].dataType.simpleString()
    return rows.join(repeated(docs, separator, least), ["id", "row"], "left").select(
        "id", F.col("text").cast("binary").alias("text"), "gone").mapInArrow(
        run, f"id {number}, n_bytes long, n_units long, n_removed long, n_removed_bytes long, kept_sha256 string,"
             " removed array<struct<unit_no: long, start: long, length: long>>, kept binary")
