"""Readers and writers on small self-written files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.session import staged
from skylattice.sources import fits, tables


def card(key, value):
    text = f"'{value}'" if isinstance(value, str) else ("T" if value is True else str(value))
    return f"{key:<8}= {text:>20}".ljust(80).encode()


def header(cards):
    raw = b"".join(cards) + b"END".ljust(80)
    return raw.ljust(math.ceil(len(raw) / 2880) * 2880, b" ")


def binary_table(name, columns):
    """columns: list of (name, form, numpy dtype, values, extra header cards)."""
    rows = len(columns[0][3])
    parts = [np.ascontiguousarray(np.asarray(v, dtype=d)).reshape(rows, -1).view("u1").reshape(rows, -1) for _, _, d, v, _ in columns]
    data = np.hstack(parts)
    cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", data.shape[1]),
             card("NAXIS2", rows), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(columns)), card("EXTNAME", name)]
    for i, (n, form, _, _, extra) in enumerate(columns, 1):
        cards += [card(f"TTYPE{i}", n), card(f"TFORM{i}", form)] + [card(k.replace("#", str(i)), v) for k, v in extra.items()]
    raw = data.tobytes()
    return header(cards) + raw.ljust(math.ceil(len(raw) / 2880) * 2880, b"\0")


def fits_file(path, tables_):
    primary = header([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0)])
    path.write_bytes(primary + b"".join(binary_table(n, c) for n, c in tables_))


def band(values, ids):
    images = np.arange(len(values) * 6, dtype=float).reshape(len(values), 6)
    return [("MAG", "D", ">f8", values, {}), ("NUMBER", "J", ">i4", ids, {"TNULL#": -1}),
            ("VIGNET", "6E", ">f4", images, {"TDIM#": "(3,2)"}), ("FLAG", "L", "S1", [b"T"] * len(ids), {}),
            ("COUNT", "I", ">i2", [1] * len(ids), {"TZERO#": 32768.0}), ("LABEL", "4A", "S4", [b"ab"] * len(ids), {})]


@pytest.fixture
def tiles(tmp_path):
    fits_file(tmp_path / "cat_1.fits", [("R", band([1.5, 2.5, float("nan")], [7, -1, 9])), ("I", band([3.5, 4.5, 5.5], [1, 2, 3]))])
    fits_file(tmp_path / "cat_2.fits", [("R", band([9.5], [4]))])
    return tmp_path


def test_fits_values(spark, tiles):
    df = fits.read_fits(spark, str(tiles), "R")
    rows = df.orderBy("tile", "ide").collect()
    assert [(r["tile"], r["ide"]) for r in rows] == [("cat_1.fits", 0), ("cat_1.fits", 1), ("cat_1.fits", 2), ("cat_2.fits", 0)]
    assert rows[0]["MAG"] == 1.5 and math.isnan(rows[2]["MAG"])
    assert [r["NUMBER"] for r in rows] == [7, None, 9, 4]
    assert rows[1]["VIGNET"] == [[6.0, 7.0, 8.0], [9.0, 10.0, 11.0]]
    assert rows[0]["FLAG"] is True and rows[0]["COUNT"] == 32769.0 and rows[0]["LABEL"] == "ab"


def test_fits_bands_side_by_side_skip_incomplete_tiles(spark, tiles):
    df = fits.read_fits(spark, str(tiles), "R,I", "MAG,NUMBER")
    assert df.columns == ["tile", "ide", "MAG_R", "NUMBER_R", "MAG_I", "NUMBER_I"]
    assert [tuple(r)[1:5:3] for r in df.orderBy("ide").collect()] == [(0, 3.5), (1, 4.5), (2, 5.5)]
    with pytest.raises(Exception, match="no table I"):
        fits.read_fits(spark, str(tiles), "R,I", "MAG", incomplete="fail").collect()


def test_fits_slices_cover_every_row_once(spark, tmp_path):
    fits_file(tmp_path / "big.fits", [("R", [("V", "K", ">i8", np.arange(5000), {})])])
    df = fits.read_fits(spark, str(tmp_path / "big.fits"), "R", splitbytes="3000")
    assert df.rdd.getNumPartitions() > 10
    assert sorted(r["V"] for r in df.collect()) == list(range(5000))
    assert df.filter("V <> ide").count() == 0


def test_fits_by_number(spark, tiles):
    assert fits.read_fits(spark, str(tiles / "cat_1.fits"), "2", "MAG").agg(F.sum("MAG")).first()[0] == 13.5


def test_delimited_text(spark, tmp_path):
    (tmp_path / "u.tsv").write_text("MAG_u\tALPHA_J2000\tother\tDELTA_J2000\tMAG_r\tMAGERR_u\n20.5\t10\tx\t-5\t99\t0.1\nnan\t11\ty\t-6\tbad\t0.2\n")
    rows = tables.read_u_survey(spark, str(tmp_path / "u.tsv")).orderBy("ALPHA_J2000").collect()
    assert tuple(rows[0]) == (10.0, -5.0, 20.5, 99.0, 0.1)
    assert rows[1]["MAG_u"] is None and rows[1]["MAG_r"] is None
    (tmp_path / "deep.rsv").write_text(",".join(tables.DEEP_SURVEY_COLUMNS) + "\n1,2,3,4,5,.1,.2,.3\n")
    assert tuple(tables.read_deep_survey(spark, str(tmp_path / "deep.rsv")).first()) == (1, 2, 3, 4, 5, 0.1, 0.2, 0.3)
    with pytest.raises(ValueError):
        tables.read_u_survey(spark, str(tmp_path / "deep.rsv"))


def test_columns_in_another_order_in_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ra,dec,z\n1,2,3\n")
    (tmp_path / "b.csv").write_text("z,extra,ra,dec\n3,x,1,2\n")
    rows = tables.read_spectroscopic(spark, str(tmp_path), "csv").collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0, 3.0)] * 2
    (tmp_path / "c.csv").write_text("z,ra\n3,1\n")
    with pytest.raises(ValueError, match="dec"):
        tables.read_spectroscopic(spark, str(tmp_path), "csv")
    with pytest.raises(ValueError):
        tables.read_tiles(spark, str(tmp_path), fmt="csv")


def test_unreadable_columns_are_named(spark, tmp_path):
    fits_file(tmp_path / "odd.fits", [("R", [("V", "K", ">i8", np.arange(3), {}), ("W", "1C", ">f4", np.zeros((3, 2)), {})])])
    with pytest.raises(Exception, match="W"):
        fits.read_fits(spark, str(tmp_path), "R").collect()
    assert fits.read_fits(spark, str(tmp_path), "R", "V").count() == 3


def heap_file(path, form, pairs, heap, rows=3, cards=()):
    """A table whose only column points into the given heap, which starts 24 bytes after the rows."""
    data = np.asarray(pairs, ">i4" if "P" in form else ">i8")
    top = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", data.nbytes // rows), card("NAXIS2", rows),
           card("PCOUNT", len(heap) + 24), card("GCOUNT", 1), card("TFIELDS", 1), card("EXTNAME", "V"), card("TTYPE1", "W"),
           card("TFORM1", form), card("THEAP", data.nbytes + 24), *cards]
    raw = data.tobytes() + b"?" * 24 + heap
    body = header(top) + raw.ljust(math.ceil(len(raw) / 2880) * 2880, b"\0")
    primary = header([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0)])
    path.write_bytes(primary + body + binary_table("NEXT", [("A", "J", ">i4", [5], {})]))


@pytest.mark.parametrize("form", ["1PI(3)", "QI"])
def test_fits_values_of_variable_length(spark, tmp_path, form, monkeypatch):
    heap = np.arange(10, 16, dtype=">i2").tobytes()
    # shared, overlapping and empty pieces, in any order
    heap_file(tmp_path / "v.fits", form, [(3, 6), (0, 999), (2, 0), (4, 0)], heap, rows=4, cards=[card("TNULL1", 11)])
    for gap, batch in ((1 << 16, 32 << 20), (0, 4)):
        monkeypatch.setattr(fits, "GAP_BYTES", gap)
        monkeypatch.setattr(fits, "BATCH_BYTES", batch)
        rows = [b for p in fits.FitsReader({"path": str(tmp_path), "hdu": "V"}, fits.FitsTables({"path": str(tmp_path), "hdu": "V"}).schema()).partitions()
                for b in fits.FitsReader({"path": str(tmp_path), "hdu": "V"}, fits.FitsTables({"path": str(tmp_path), "hdu": "V"}).schema()).read(p)]
        assert [v for b in rows for v in b.column(2).to_pylist()] == [[13, 14, 15], [], [10, None], [10, None, 12, 13]]
    df = fits.read_fits(spark, str(tmp_path), "V")
    assert df.schema["W"].dataType.simpleString() == "array<smallint>" and df.count() == 4
    assert fits.read_fits(spark, str(tmp_path), "NEXT").first()["A"] == 5


def test_fits_pointers_outside_the_heap(spark, tmp_path):
    heap_file(tmp_path / "v.fits", "1PE(3)", [(3, 0), (0, 0), (1, 12)], b"\0" * 12)
    with pytest.raises(Exception, match="outside the heap"):
        fits.read_fits(spark, str(tmp_path), "V").collect()


def test_fits_written_by_tasks(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.5, nan, None], "it's", True, 7, [1, 2], 0.5), (None, [], "", None, None, [], None), (3, None, None, False, -5, None, 2.5)]
    rows += [(k, [float(k)] * (k % 7), "x" * (k % 5), k % 2 == 0, k, list(range(k % 3)), float(k)) for k in range(10, 1500)]
    names = "k bigint, v array<double>, t string, b boolean, s smallint, w array<int>, f float"
    df = spark.createDataFrame(rows, names).repartition(3)
    path = str(tmp_path / "out")
    fits.write_fits(df, path, "T", filebytes=20000)
    files = list((tmp_path / "out").iterdir())
    assert len(files) > 3 and all(f.suffix == ".fits" for f in files) and all(f.stat().st_size % 2880 == 0 for f in files)
    back = fits.read_fits(spark, path, "T").drop("tile", "ide")
    assert [f.dataType for f in back.schema] == [f.dataType for f in df.schema]

    def plain(r):
        f = "nan" if r[6] is None or math.isnan(r[6]) else r[6]
        return repr((r[0], [nan if v is None else v for v in r[1] or []], r[2] or "", r[3], r[4], list(r[5] or []), f))
    assert sorted(map(plain, back.collect())) == sorted(map(plain, rows))
    fits.write_fits(df.limit(5), path, "T")
    assert fits.read_fits(spark, path, "T").count() == len(rows) + 5
    with pytest.raises(Exception, match="stands for a missing value"):
        fits.write_fits(spark.createDataFrame([(-2**63,), (None,)], "k bigint").coalesce(1), str(tmp_path / "bad"), "T")
    # what a failed job left is not listed
    assert not [f for f in (tmp_path / "bad").iterdir() if f.suffix == ".fits"]
    with pytest.raises(Exception, match="cannot be written"):
        fits.write_fits(spark.createDataFrame([([["a"]],)], "k array<array<string>>"), str(tmp_path / "odd"), "T")
    fits.write_fits(df.filter("false"), path, "T")


def test_equal_names_in_two_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        fits_file(tmp_path / folder / "cat.fits", [("R", [("V", "K", ">i8", np.arange(2), {})])])
    df = fits.read_fits(spark, str(tmp_path), "R")
    assert df.select("tile", "ide").distinct().count() == 4


def test_batches_follow_the_width_of_a_row(spark, tmp_path, monkeypatch):
    fits_file(tmp_path / "wide.fits", [("R", [("V", "100D", ">f8", np.arange(5000).reshape(50, 100), {})])])
    sizes = []
    real = fits.pa.RecordBatch.from_arrays
    monkeypatch.setattr(fits, "BATCH_BYTES", 8000)
    schema = fits.FitsTables({"path": str(tmp_path), "hdu": "R"}).schema()
    reader = fits.FitsReader({"path": str(tmp_path), "hdu": "R"}, schema)
    for part in reader.partitions():
        sizes += [b.num_rows for b in reader.read(part)]
    assert sizes == [10] * 5 and real


def test_spectroscopic_and_in_memory_tables(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, float("nan"))], "ra double, dec double, z double")
    tables.write_table(df, str(tmp_path / "spec"))
    row = tables.read_spectroscopic(spark, str(tmp_path / "spec")).first()
    assert row.asDict() == {"RA": 1.0, "DEC": 2.0, "Z_SPEC": None}
    assert tables.as_table(spark, df) is df
    assert tables.as_table(spark, path=str(tmp_path / "spec")).count() == 1
    with pytest.raises(ValueError):
        tables.as_table(spark)


def test_directory_of_tiles_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, float("nan"))], "tile string, ide bigint, v double")
    tables.write_table(df, str(tmp_path / "parts"), ["tile"])
    assert {(r["tile"], r["v"]) for r in tables.read_tiles(spark, str(tmp_path / "parts")).collect()} == {("a", 2.0), ("b", None)}
    for name in ("cat_1", "cat_2"):
        (tmp_path / "csv").mkdir(exist_ok=True)
        (tmp_path / "csv" / f"{name}.csv").write_text("v\n1.5\n")
    out = tables.read_tiles(spark, str(tmp_path / "csv"), tables.doubles(["v"]), "csv")
    assert {(r["tile"], r["v"]) for r in out.collect()} == {("cat_1.csv", 1.5), ("cat_2.csv", 1.5)}


def test_union_and_weights(spark):
    a = spark.createDataFrame([(1, 2.0)], "k bigint, x double")
    b = spark.createDataFrame([(2, 3.0)], "k bigint, y double")
    whole = tables.union_tables([a, b])
    assert whole.columns == ["k", "x", "y"] and whole.count() == 2
    weighted = tables.join_weights(whole, spark.createDataFrame([(1, 0.5)], "k bigint, weight double"), ["k"])
    assert {(r["k"], r["weight"]) for r in weighted.collect()} == {(1, 0.5), (2, None)}


def test_staged_tables_keep_rows_and_names(spark):
    df = spark.createDataFrame([(1.0, [[1.0]])], "`Surf. bright.` double, image array<array<float>>")
    again = staged(df)
    assert again.columns == df.columns and again.collect() == df.collect()
