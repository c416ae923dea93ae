"""Small hand-made tables for cuts, histograms, order statistics, weights, imputation, folds."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice.config import SurveyConfig
from skylattice.functions import names
from skylattice.operators import (
    cuts, folds, histogram, impute, metrics, order_stats, pixel_stats, pixels, project, scale, statistics, weights,
)

NAN = float("nan")


def column(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


# --- cuts and projections ------------------------------------------------------------------

def test_detection_cut_is_strict_and_drops_nan(spark):
    rows = [(10.0, 1.0, 20.0, 0.1), (10.1, 1.0, 20.0, 0.1), (500.0, 1.0, 20.0, 0.1), (NAN, 1.0, 20.0, 0.1),
            (20.0, NAN, 20.0, 0.1), (20.0, 1.0, 30.0, 0.1), (20.0, 1.0, 20.0, 0.5), (20.0, 0.8 / 3600, 20.0, 0.1)]
    df = spark.createDataFrame(rows, "SNR double, FWHM double, MAG double, MAG_ERR double")
    capped = cuts.detection_cut(df, SurveyConfig.capped_range(["R"])).collect()
    assert [r["SNR"] for r in capped] == [10.1]
    assert cuts.detection_cut(df, SurveyConfig.open_range(["R"])).count() == 2
    assert cuts.detection_cut(df, SurveyConfig.uncut(["R"])).count() == len(rows)


def test_errors_and_redshift_filters(spark):
    df = spark.createDataFrame([(0.1, 1.0), (None, 1.0), (NAN, 1.0), (0.1, NAN), (0.1, 0.0), (0.5, 1.0)], "e double, z double")
    assert cuts.errors_below(df, ["e"]).count() == 3
    assert cuts.positive(df, "z").count() == 4
    assert cuts.has_value(df, "z").count() == 5
    assert cuts.complete_rows(df).count() == 3


def test_lonely_objects(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "tile string, ide bigint")
    assert [(r["tile"], r["ide"]) for r in cuts.lonely_objects(df, "ide").collect()] == [("a", 1)]


def test_magnitude_sentinels_spare_the_first_band(spark):
    df = spark.createDataFrame([(99.0, 99.0), (20.0, 98.0), (20.0, NAN)], "MAG_AUTO_R double, MAG_AUTO_I double")
    out = project.magnitude_sentinels(df, SurveyConfig.open_range(["R", "I"]), ["MAG_AUTO"]).collect()
    assert [r["MAG_AUTO_R"] for r in out] == [99.0, 20.0, 20.0]
    assert [r["MAG_AUTO_I"] for r in out] == [None, 98.0, None]


def test_zero_point(spark):
    df = spark.createDataFrame([(20.0, 21.0)], "MAG_AUTO_R double, MAG_AUTO_I double")
    shifted = project.zero_point(df, SurveyConfig.capped_range(["R", "I"])).first()
    assert (shifted["MAG_AUTO_R"], shifted["MAG_AUTO_I"]) == (20.0, 16.0)
    assert project.zero_point(df, SurveyConfig.open_range(["R", "I"])).first() == df.first()


def test_sentinel_values(spark):
    df = spark.createDataFrame([(0.0, -1.0), (-99.0, -10.0), (99.0, 5.0), (NAN, None)], "a double, b double")
    assert [tuple(r) for r in project.external_sentinels(df).collect()] == [
        (None, -1.0), (None, -10.0), (None, 5.0), (None, None)]
    assert [tuple(r) for r in project.training_sentinels(df).collect()] == [
        (0.0, None), (None, None), (99.0, 5.0), (None, None)]


def test_colours_are_taken_by_name(spark):
    df = spark.createDataFrame([(20.0, 23.0, 19.0, 0.5)], "r double, u double, i double, z double")
    out = project.colours(df, ("r", "u", "i"), ("i", "r", "u"))
    assert out.columns == ["r", "i-r", "r-u", "z"]
    assert tuple(out.first()) == (20.0, -1.0, -3.0, 0.5)
    assert len(project.colour_variants(df, ("r", "u", "i"))) == 7
    with pytest.raises(ValueError):
        project.colours(df, ("r", "u"), ("r", "x"))


def test_names_and_letters(spark):
    df = spark.createDataFrame([("cat_12.fits", 7, "giruz", "rzi")], "t string, i bigint, a string, b string")
    row = df.select(
        names.object_name(F.col("t"), F.col("i")).alias("n"), names.uncommon_letters(F.col("a"), F.col("b")).alias("l"),
        names.with_error(F.lit(0.12345), F.lit(0.5)).alias("e")).first()
    assert (row["n"], row["l"], row["e"]) == ("12_7", ["g", "u"], "0.123+-0.500")
    assert len(names.band_orders("ruiz")) == 24 and len(names.band_subsets("ruizg")) == 30


def test_renames(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "MAG_AUTO_R double, i_stk_aper double, other double")
    assert project.rename_for_weights(df).columns == ["r", "i", "other"]
    shear = project.shear(spark.createDataFrame([(0.5, -0.75)], "gal_g1 double, gal_g2 double"))
    assert shear.first().asDict() == {"gal_g": 0.25}


# --- histograms ----------------------------------------------------------------------------

@pytest.mark.parametrize("bins", [1, 4, 7])
def test_histogram_equals_numpy(spark, bins):
    values = [0.0, 0.25, 0.5, 0.5, 0.75, 1.0, 0.1, 0.99]
    table = histogram.histogram(column(spark, values + [NAN, None]), "v", bins, density=True).orderBy("bin").toPandas()
    counts, edges = np.histogram(values, bins=bins)
    assert list(table["cnt"]) == list(counts)
    assert np.allclose(table["lower"], edges[:-1]) and np.allclose(table["upper"], edges[1:])
    assert np.allclose(table["density"], np.histogram(values, bins=bins, density=True)[0])


def test_histogram_of_a_fixed_range_and_of_one_value(spark):
    table = histogram.histogram(column(spark, [-1.0, 0.0, 1.0, 2.0, 3.0]), "v", 2, (0.0, 2.0)).orderBy("bin").collect()
    assert [r["cnt"] for r in table] == [1, 2]
    flat = histogram.histogram(column(spark, [5.0, 5.0]), "v", 4).orderBy("bin").toPandas()
    assert list(flat["cnt"]) == list(np.histogram([5.0, 5.0], bins=4)[0])


def test_histogram2d_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(NAN, 1.0)], "x double, y double")
    expected = np.histogram2d(x, y, bins=(5, 6))[0]
    found = np.zeros((5, 6))
    for r in histogram.histogram2d(df, "x", "y", (5, 6)).collect():
        found[r["bx"], r["by"]] = r["cnt"]
    assert (found == expected).all()


# --- order statistics ----------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["normal", "copies", "outlier", "few"])
def test_medians_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=2001), "copies": np.r_[np.full(700, 2.0), rng.normal(2.0, 1e-3, 1300)],
        "outlier": np.r_[rng.normal(size=1500), 1e300, -1e300], "few": np.array([3.0, 1.0]),
    }[kind]
    df = column(spark, [float(v) for v in values] + [NAN, None])
    assert order_stats.medians(df, ["v"])["v"] == pytest.approx(float(np.median(values)), rel=1e-15)
    assert order_stats.quantiles(df, "v", [0.0, 0.25, 0.9, 1.0]) == pytest.approx(
        list(np.quantile(values, [0.0, 0.25, 0.9, 1.0])), rel=1e-12)


def test_ranks_through_few_parts(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "BUCKETS", 3)
    values = list(range(500))
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    ranks = [0, 1, 17, 250, 498, 499]
    assert order_stats.order_statistics(df, {"v": ranks})["v"] == ranks


def test_passes_are_grouped_counts(spark):
    """No sketch and no gathered column: every plan of a pass is a partial count by part."""
    import inspect
    source = inspect.getsource(order_stats)
    assert "percentile" not in source and "collect_list" not in source


def test_ranks_of_integers_beyond_double_precision(spark):
    start = 2**61 + 1
    df = spark.range(start, start + 300).select(F.col("id").alias("v"))
    ranks = [0, 1, 150, 299]
    assert order_stats.order_statistics(df, {"v": ranks})["v"] == [start + r for r in ranks]


def test_median_of_nothing(spark):
    assert order_stats.medians(column(spark, [None, NAN]), ["v"]) == {"v": None}
    with pytest.raises(ValueError):
        order_stats.order_statistics(column(spark, [1.0]), {"v": [1]})


# --- scores and statistics -----------------------------------------------------------------

def test_scores_by_hand(spark):
    rows = [(1.0, 1.0), (1.0, 1.2), (1.0, 0.8), (1.0, 1.4), (1.0, 0.2)]
    df = spark.createDataFrame(rows, "y_test double, y_pred double")
    dz = np.array([(a - b) / (1 + a) for a, b in rows])
    sigma = 1.4826 * np.median(np.abs(dz - np.median(dz)))
    s = metrics.scores(df)
    assert s.sigma == pytest.approx(sigma) and s.eta == pytest.approx(0.4) and s.bias == pytest.approx(dz.mean())
    assert s.score == pytest.approx(math.sqrt(dz.mean() ** 2 + sigma**2)) and s.total == pytest.approx(sigma + 0.4)
    summary = metrics.summarise([1.0, 3.0])
    assert (summary.mean, summary.error) == (2.0, pytest.approx(1 / math.sqrt(2)))


def test_correlation_uses_pairwise_rows(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, None], "b": [2.0, 1.0, None, 5.0, 1.0], "c": [1.0, 4.0, 2.0, 2.0, 7.0]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double")
    expected = pdf.corr()
    found = statistics.correlation_matrix(df).collect()
    assert len(found) == 9
    for r in found:
        assert r["corr"] == pytest.approx(expected.loc[r["a"], r["b"]])


def test_missing_report(spark):
    df = spark.createDataFrame([(1.0, None, NAN), (1.0, 2.0, 1.0), (2.0, None, 1.0), (2.0, None, 1.0)], "a double, b double, c double")
    assert [tuple(r) for r in statistics.missing_report(df).collect()] == [("b", 75.0), ("c", 25.0)]


# --- weights -------------------------------------------------------------------------------

def numpy_weights(train, population):
    n = len(train) // 10
    def histo(v):
        density, edges = np.histogram(v, bins=n, density=True)
        return density, edges[0], (edges[-1] - edges[0]) / n
    (td, tlo, ts), (pd_, plo, ps) = histo(train), histo(population)
    def look(x, lo, step):
        return int(min(n - 1, max(0, math.ceil((x - lo) / step) - 1)))
    out = []
    for x in train:
        above = pd_[look(x, plo, ps)] if population.min() <= x <= population.max() else 0.0
        below = td[look(x, tlo, ts)]
        out.append(above / below if below else None)
    return out


def test_weights_equal_a_plain_computation(spark):
    rng = np.random.default_rng(2)
    train, population = rng.normal(20, 2, 200), rng.normal(21, 1, 3000)
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(train)], "obj_id bigint, r double")
    p = spark.createDataFrame([(float(v),) for v in population], "r double")
    found = {r["obj_id"]: r["weight"] for r in weights.band_weights(t, p, ["obj_id"], "r").collect()}
    for i, expected in enumerate(numpy_weights(train, population)):
        assert found[i] == (pytest.approx(expected) if expected is not None else None)


def test_weights_of_several_bands(spark):
    rng = np.random.default_rng(3)
    t = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(20, 1, (100, 2)))]
    t[7] = (7, t[7][1], None)
    df = spark.createDataFrame(t, "obj_id bigint, r double, u double")
    both = {r["obj_id"]: r["weight"] for r in weights.mean_weights(df, df, ["obj_id"], ["r", "u"]).collect()}
    r = {x["obj_id"]: x["weight"] for x in weights.band_weights(df, df, ["obj_id"], "r").collect()}
    u = {x["obj_id"]: x["weight"] for x in weights.band_weights(df, df, ["obj_id"], "u").collect()}
    assert both[7] is None and len(both) == 100
    for i in set(range(100)) - {7}:
        if r[i] is not None and u[i] is not None:
            assert both[i] == pytest.approx((r[i] + u[i]) / 2)


def test_weights_need_ten_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "obj_id bigint, r double")
    with pytest.raises(Exception, match="ten training rows"):
        weights.band_weights(df, df, ["obj_id"], "r").collect()


# --- imputation ----------------------------------------------------------------------------

def gaps(spark):
    rows = [(i, 1.0 if i < 8 else 2.0, 5.0, 1.0) for i in range(20)]
    rows[0] = (0, -99.0, 5.0, 1.0)
    rows[1] = (1, None, 5.0, 1.0)
    return spark.createDataFrame([(k, a, None if k % 5 == 0 else b, z) for k, a, b, z in rows],
                                 "k bigint, a double, b double, z double")


@pytest.mark.parametrize("method,fill", [("mean", (6 + 24) / 18), ("mode", 2.0), ("median", 2.0), (7, 7.0)])
def test_fill_methods(spark, method, fill):
    plan = impute.fit(gaps(spark), method, keep=["k"], protect=["z"])
    assert plan.dropped == ("b",)
    out = {r["k"]: r for r in impute.apply(gaps(spark), plan).collect()}
    assert out[0]["a"] == pytest.approx(fill) and out[1]["a"] == pytest.approx(fill) and out[2]["a"] == 1.0
    assert len(out) == 20 and "b" not in out[0].asDict()


def test_drop_and_none(spark):
    assert impute.apply(gaps(spark), impute.fit(gaps(spark), "drop", keep=["k"])).count() == 18
    same = impute.apply(gaps(spark), impute.fit(gaps(spark), None, keep=["k"]))
    assert same.columns == ["k", "a", "b", "z"] and same.count() == 20


def test_mode_ties_go_to_the_smaller_value(spark):
    assert impute.modes(column(spark, [3.0, 3.0, 1.0, 1.0, NAN, None]), ["v"]) == {"v": 1.0}


def test_unknown_methods_and_left_gaps(spark):
    for bad in ("other", True, [1]):
        with pytest.raises(ValueError):
            impute.fit(gaps(spark), bad)
    with pytest.raises(ValueError, match="a"):
        impute.check_complete(gaps(spark), ["a"])


def test_statistics_come_from_the_train_part(spark):
    a = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0)] * 10, "x double, z double")
    b = spark.createDataFrame([(100.0, 1.0)] * 9 + [(None, 1.0)], "x double, z double")
    _, test, _ = impute.preprocess(a, b, "mean", protect=["z"])
    assert min(r["x"] for r in test.collect()) == 2.0
    _, each, _ = impute.preprocess(a, b, "mean", protect=["z"], fit_each=True)
    assert min(r["x"] for r in each.collect()) == 100.0


# --- folds ---------------------------------------------------------------------------------

def test_exact_folds(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    for folded in (folds.shuffled_folds(df, ["k"], 4, seed=5, exact=True), folds.contiguous_folds(df, "k", 4)):
        sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
        assert sizes == {0: 25, 1: 25, 2: 25, 3: 28}
    last = {r["k"] for r in folds.contiguous_folds(df, "k", 4).filter("fold = 3").collect()}
    assert last == set(range(75, 103))
    with pytest.raises(ValueError):
        folds.contiguous_folds(spark.range(2), "id", 4)


def test_folds_do_not_follow_a_pattern_of_the_keys(spark):
    df = spark.range(0, 50_000, 5)
    sizes = {r["fold"]: r["count"] for r in folds.shuffled_folds(df, ["id"], 5).groupBy("fold").count().collect()}
    assert all(1800 < s < 2200 for s in sizes.values()) and len(sizes) == 5


def test_holdout_shares_and_text_keys(spark):
    df = spark.range(20_000).select(F.concat(F.lit("obj"), F.col("id")).alias("k"))
    sizes = {r["part"]: r["count"] for r in folds.holdout(df, ["k"], 0.2, validation=True).groupBy("part").count().collect()}
    assert abs(sizes["test"] - 4000) < 300 and abs(sizes["validation"] - 3200) < 300 and sum(sizes.values()) == 20_000


def test_shuffle_keeps_values_and_other_columns(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"), F.when(F.col("id") > 4, F.col("id")).alias("b"))
    out = folds.shuffle_column(df, ["k"], "b", seed=1, group_rows=300)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted((r["k"], r["a"]) for r in rows) == [(i, 2 * i) for i in range(1000)]
    assert sorted(r["b"] for r in rows if r["b"] is not None) == list(range(5, 1000))
    assert sum(r["b"] == r["k"] for r in rows) < 20


# --- scaling and pixels --------------------------------------------------------------------

def test_scaling(spark):
    values = np.array([1.0, 2.0, 4.0, 8.0, 16.0])
    df = spark.createDataFrame([(float(v), 3.0) for v in values], "a double, b double")
    standard = scale.fit(df, ["a", "b"], "standard").apply(df).toPandas()
    assert np.allclose(standard["a"], (values - values.mean()) / values.std()) and (standard["b"] == 0).all()
    robust = scale.fit(df, ["a"], "robust").apply(df).toPandas()
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    assert np.allclose(robust["a"], (values - q2) / (q3 - q1))
    with pytest.raises(ValueError):
        scale.fit(df, ["a"], "other")


def test_pixels(spark):
    images = [[[1.0, -5.0], [NAN, 2.0]], [[3.0, -1.0], [0.5, 4.0]]]
    df = spark.createDataFrame([(i, im) for i, im in enumerate(images)], "k int, im array<array<float>>")
    masked = [r["m"] for r in df.orderBy("k").select(pixels.mask_bad(F.col("im")).alias("m")).collect()]
    assert masked == [[[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0], [0.5, 4.0]]]
    stacked = df.filter("k = 1").select(pixels.stack_bands([F.col("im"), F.col("im")]).alias("s")).first()["s"]
    assert stacked == [[[3.0, 3.0], [-1.0, -1.0]], [[0.5, 0.5], [4.0, 4.0]]]
    flat = np.array([1.0, -5.0, 2.0, 3.0, -1.0, 0.5, 4.0])
    scale_ = pixels.pixel_scales(df, ["im"])["im"]
    assert scale_ == pytest.approx(1.482602218505602 * np.median(np.abs(flat - np.median(flat))))
    out = pixels.prepare_images(df.filter("k = 1"), [df.filter("k = 1")], ["im"])
    one = np.array(images[1]).ravel()
    spread = 1.482602218505602 * np.median(np.abs(one - np.median(one)))
    assert np.allclose(np.array(out[1].first()["im"]).ravel(), np.arcsinh(one / spread))


def test_pixel_medians_without_a_row_per_pixel(spark, monkeypatch):
    rng = np.random.default_rng(5)
    flat = [*rng.normal(0, 1, 400), *(-10.0 ** rng.uniform(-300, 300, 40)), 0.0, -0.0, 5e-324, 1.7e308, np.inf, -np.inf, NAN]
    images = [[[float(v) for v in part[:3]], [float(v) for v in part[3:]]] for part in np.array_split(flat, 60)]
    images += [None, [], [None, [1.0, None]]]
    df = spark.createDataFrame([(im, [im[0]] if im else None) for im in images], "im array<array<double>>, `a.b` array<array<double>>")
    known = np.array([v for im in images if im for row in im if row for v in row if v is not None and v == v])
    first = np.array([v for im in images if im and im[0] for v in im[0] if v is not None and v == v])
    plans = []
    counted = pixel_stats._counted
    monkeypatch.setattr(pixel_stats, "_counted", lambda d, *rest: plans.append(d) or counted(d, *rest))
    found = pixel_stats.pixel_medians(df, ["im", "a.b"])
    assert found == {"im": np.median(known), "a.b": np.median(first)} and len(plans) == 4
    assert not any("Explode" in d._jdf.queryExecution().toString() for d in plans)
    away = pixel_stats.pixel_medians(df, ["im"], {"im": 0.25})["im"]
    assert away == np.median(np.abs(known - 0.25))
    bits = pixel_stats.ordered_bits(np.sort(known))
    assert (np.diff(bits.astype(object)) >= 0).all() and [pixel_stats.from_bits(int(b)) for b in bits] == sorted(known)
    nothing = df.filter("false")
    assert pixel_stats.pixel_medians(nothing, ["im"]) == {"im": None} and pixels.pixel_scales(nothing, ["im"]) == {"im": None}
    floats = spark.createDataFrame([([0.1, 0.7],), ([0.3],)], "p array<float>")
    assert pixel_stats.pixel_medians(floats, ["p"])["p"] == float(np.float32(0.3))


def test_flat_pixels_as_image(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "p array<double>")
    assert df.select(pixels.as_image(F.col("p"), 3).alias("i")).first()["i"] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]


def test_exact_folds_of_keys_that_share_a_number(spark):
    rows = [(k + j * 2147483647,) for k in range(10) for j in range(2)]
    sizes = folds.shuffled_folds(spark.createDataFrame(rows, "k bigint"), ["k"], 4, exact=True).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [5, 5, 5, 5]
    text = spark.createDataFrame([(f"a{i % 7}", i) for i in range(1003)], "a string, b int")
    sizes = folds.shuffled_folds(text, ["a", "b"], 4, exact=True).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [250, 250, 250, 253]


def test_block_order_statistics_are_exact_and_make_no_row_for_a_value(spark):
    """Groups side by side in the rows: ranks, sums and scores as by sorting, with gaps, ties and extreme values."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(500, 6)), 2)
    x[:, 1] = 3.0
    x[:, 2] = np.where(rng.random(500) < 0.7, 0.25, x[:, 2])
    x[:2, 3] = -1.7e308, 1.7e308
    x[rng.random((500, 6)) < 0.2] = np.nan
    x[1:, 5] = np.nan
    x[0, 5] = 7.0
    table = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)

    def blocks(batch):
        m = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
        yield np.arange(4), m[:, :4]
        yield np.array([5, 4]), m[:, [5, 4]]

    kept = [np.sort(c[~np.isnan(c)]) for c in x.T]
    ranks = {g: sorted({0, len(v) // 4, len(v) // 2, len(v) - 1}) for g, v in enumerate(kept)}
    assert order_stats.block_order_statistics(table, blocks, ranks) == {g: [kept[g][k] for k in of] for g, of in ranks.items()}
    sums = order_stats.block_sums(table, blocks, 6, 0.15)
    assert [sums[g]["n"] for g in range(6)] == [len(v) for v in kept]
    assert [sums[g]["far"] for g in range(6)] == [int((np.abs(v) > 0.15).sum()) for v in kept]
    with pytest.raises(ValueError):
        order_stats.block_order_statistics(table, blocks, {0: [len(kept[0])]})
    long = table.select(F.posexplode("x").alias("g", "dz")).where("NOT isnan(dz) AND g < 3")
    three = lambda batch: [(g[:3], m[:, :3]) for g, m in blocks(batch) if len(g) == 4]
    plain, found = metrics.grouped_scores(long, "g", "dz", 3), metrics.block_scores(table, three, 3)
    for g in range(3):
        assert found[g].sigma == plain[g].sigma and found[g].rows == plain[g].rows
        assert found[g].eta == pytest.approx(plain[g].eta) and found[g].bias == pytest.approx(plain[g].bias, abs=1e-12)
