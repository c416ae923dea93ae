"""Statistics, weights, features, imputation, folds and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.fixtures import ctes, read, view
from skylattice.functions.names import band_subsets, uncommon_letters, with_error
from skylattice.operators import (
    folds, histogram, impute, metrics, order_stats, pixels, project, scale, statistics, weights,
)
from skylattice.operators.folds import MODULUS, MULTIPLIER, SEED_STEP

TRAIN_COLUMNS = ("r", "u", "i", "z", "g", "gini", "z_spec")
BANDS = ("r", "u", "i", "z", "g")


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def train(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "train")


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return project.training_sentinels(train(spark, sf), TRAIN_COLUMNS)


def pred(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "pred")


# --- histograms ----------------------------------------------------------------------------

def _bins_sql(source: str, column: str, n: int) -> str:
    """Equal-width bins between the extremes, closed on the left."""
    return (
        f"e AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),"
        f" b AS (SELECT least({n - 1}, CAST(floor(({column}-lo)/((hi-lo)/{n}e0)) AS BIGINT)) AS bin FROM {source}, e"
        f" WHERE {column} IS NOT NULL),"
        f" c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),"
        f" h AS (SELECT CAST(s.bin AS BIGINT) AS bin, round(lo+s.bin*((hi-lo)/{n}e0),8) AS lower,"
        f" round(lo+(s.bin+1)*((hi-lo)/{n}e0),8) AS upper, coalesce(cnt,0) AS cnt, (hi-lo)/{n}e0 AS step"
        f" FROM range({n}) s(bin) CROSS JOIN e LEFT JOIN c ON c.bin=s.bin)"
    )


def _hist(spark, sf, density=False):
    out = histogram.histogram(clean(spark, sf), "z_spec", 50, density=density)
    return rounded(out, "lower", "upper", *(["density"] if density else []))


def _bin2_sql(x: str, y: str) -> str:
    def one(c, lo, hi):
        return f"least(49, CAST(floor(({c}-{lo})/(({hi}-{lo})/5e1)) AS BIGINT))"
    return (
        f"e AS (SELECT min({x}) AS xl, max({x}) AS xh, min({y}) AS yl, max({y}) AS yh FROM s)"
        f" SELECT {one(x, 'xl', 'xh')} AS bx, {one(y, 'yl', 'yh')} AS by, count(*) AS cnt FROM s, e GROUP BY 1, 2"
    )


def colour_colour(spark: SparkSession, sf: str) -> DataFrame:
    """r-i against u-r, over the objects that have all three."""
    t = clean(spark, sf).select((F.col("r") - F.col("i")).alias("ri"), (F.col("u") - F.col("r")).alias("ur"))
    return histogram.histogram2d(t, "ri", "ur")


# --- scores --------------------------------------------------------------------------------

def sigma_eta(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.scores(pred(spark, sf))
    row = pred(spark, sf).agg(F.count("y_pred").alias("n"))
    return row.select(
        "n", *[F.round(F.lit(v), 8).alias(n) for n, v in
               (("sigma", s.sigma), ("eta", s.eta), ("bias", s.bias), ("score", s.score), ("total", s.total))]
    )


SCORE_CTE = (
    f"{ctes('pred')}, d AS (SELECT fold, (y_test-y_pred)/(1e0+y_test) AS dz FROM pred)"
)
SIGMA = "1.4826e0*median(abs(dz-m))"


def fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.scores_by(pred(spark, sf), "fold", [0, 1, 2, 3])
    counted = pred(spark, sf).groupBy("fold").agg(F.count("y_pred").alias("n"))
    table = spark.createDataFrame(
        [(k, s.sigma, s.eta, s.score) for k, s in found.items()], "fold bigint, sigma double, eta double, score double"
    )
    return rounded(counted.join(F.broadcast(table), "fold"), "sigma", "eta", "score")


def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.scores_by(pred(spark, sf), "fold", [0, 1, 2, 3])
    s = metrics.summarise([f.score for f in found.values()])
    counted = pred(spark, sf).agg(F.count_distinct("fold").alias("folds"))
    return counted.select(
        "folds", F.round(F.lit(s.mean), 8).alias("score"), F.round(F.lit(s.error), 8).alias("error"),
        with_error(F.lit(s.mean), F.lit(s.error)).alias("report"),
    )


FOLD_CTE = (
    f"{SCORE_CTE}, fm AS (SELECT fold, median(dz) AS m, avg(dz) AS b FROM d GROUP BY fold), fs AS (SELECT d.fold,"
    f" count(*) AS n, {SIGMA} AS sigma, avg(CASE WHEN abs(dz)>1.5e-1 THEN 1e0 ELSE 0e0 END) AS eta, min(b) AS b"
    " FROM d JOIN fm ON fm.fold=d.fold GROUP BY d.fold), ft AS (SELECT fold, n, sigma, eta, sqrt(b*b+sigma*sigma) AS score FROM fs)"
)


def medians(spark: SparkSession, sf: str) -> DataFrame:
    found = order_stats.medians(clean(spark, sf), TRAIN_COLUMNS)
    return clean(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(
        "n", *[F.lit(found[c]).alias(c) for c in TRAIN_COLUMNS]
    )


# --- weights -------------------------------------------------------------------------------

def _weight_sql(column: str, name: str) -> str:
    bins = "CAST((SELECT count(*) FROM train)/10 AS BIGINT)"
    def side(p, table):
        return (
            f"{name}{p}e AS (SELECT min({column}) AS lo, max({column}) AS hi, count({column}) AS t,"
            f" (max({column})-min({column}))/(SELECT floor(count(*)/1e1) FROM trainc) AS step FROM {table}),"
            f" {name}{p} AS (SELECT least((SELECT floor(count(*)/1e1) FROM trainc)-1, floor(({column}-lo)/step)) AS bin,"
            f" count(*)/(min(t)*min(step)) AS density FROM {table}, {name}{p}e WHERE {column} IS NOT NULL GROUP BY 1)"
        )
    look = "least((SELECT floor(count(*)/1e1) FROM trainc)-1, greatest(0, ceil(({c}-{e}.lo)/{e}.step)-1))"
    return (
        f"{side('t', 'trainc')}, {side('p', 'population')},"
        f" {name} AS (SELECT x.obj_id, CASE WHEN x.{column} IS NULL THEN NULL WHEN x.{column}<pe.lo OR x.{column}>pe.hi"
        f" THEN 0e0/nullif(td.density,0e0) ELSE coalesce(pd.density,0e0)/nullif(td.density,0e0) END AS weight"
        f" FROM trainc x CROSS JOIN {name}te te CROSS JOIN {name}pe pe"
        f" LEFT JOIN {name}t td ON td.bin={look.format(c='x.' + column, e='te')}"
        f" LEFT JOIN {name}p pd ON pd.bin={look.format(c='x.' + column, e='pe')})"
    )


CLEAN_CTE = (
    f"{ctes('train')}, trainc AS (SELECT obj_id, "
    + ", ".join(f"CASE WHEN {c} NOT IN (-1e0,-1e1,-99e0) THEN {c} END AS {c}" for c in TRAIN_COLUMNS)
    + " FROM train)"
)


# --- features ------------------------------------------------------------------------------

ORDER = ("i", "g", "r", "z", "u")


def colour_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Every colour of every order of the bands: order number, colour name, mean colour, from one pass."""
    base = train(spark, sf).select("obj_id", *BANDS, "z_spec")
    names = [[c for c in t.columns if "-" in c] for t in project.colour_variants(base, BANDS)]
    pairs = sorted({n for found in names for n in found})
    row = base.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(a) - F.col(b)), 8).alias(f"{a}-{b}") for a, b in (n.split("-") for n in pairs)])
    cells = [F.struct(F.lit(k).alias("variant"), F.lit(n).alias("colour"), F.col(f"`{n}`").alias("mean_colour"))
             for k, found in enumerate(names) for n in found]
    return row.select(F.inline(F.array(*cells)), "n")


def _colour_orders_sql() -> str:
    from itertools import permutations
    pairs = ", ".join(f"round(avg({a}-{b}),8) AS \"{a}-{b}\"" for a in BANDS for b in BANDS if a != b)
    rows = ", ".join(f"({number}, '{a}-{b}')" for number, p in enumerate(permutations(BANDS), 1) for a, b in zip(p, p[1:]))
    return (f"WITH {ctes('train')}, m AS (SELECT count(*) AS n, {pairs} FROM train), c AS (UNPIVOT m ON COLUMNS(* EXCLUDE n) INTO NAME colour VALUE mean_colour)"
            f" SELECT CAST(v.variant AS INTEGER) AS variant, v.colour, mean_colour, n FROM (VALUES {rows}) v(variant, colour) JOIN c USING (colour)")


def letters(spark: SparkSession, sf: str) -> DataFrame:
    """Letters that differ between a part's name and its type, row by row."""
    p = read(spark, sf, "part").select("p_partkey", *[F.lower(F.regexp_replace(c, "[^A-Za-z]", "")).alias(n) for c, n in (("p_name", "a"), ("p_type", "b"))])
    return p.select("p_partkey", F.array_join(uncommon_letters(F.col("a"), F.col("b")), "").alias("letters"))


def subset_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the summed magnitudes for every band subset of sizes 1 to 4."""
    t = view(spark, sf, "population")
    subsets = band_subsets(BANDS)
    row = t.agg(*[F.round(F.avg(sum(F.col(b) for b in s)), 6).alias("".join(s)) for s in subsets])
    cells = [F.struct(F.lit("".join(s)).alias("bands"), F.col("".join(s)).alias("mean_sum")) for s in subsets]
    return row.select(F.inline(F.array(*cells)))


def _subset_sql() -> str:
    return f"WITH {ctes('population')} " + " UNION ALL ".join(
        f"SELECT '{''.join(s)}' AS bands, round(avg({'+'.join(s)}),6) AS mean_sum FROM population"
        for s in band_subsets(BANDS)
    )


# --- imputation ----------------------------------------------------------------------------

def imputed(method):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        plan = impute.fit(train(spark, sf), method, TRAIN_COLUMNS, protect=["z_spec"])
        return rounded(impute.apply(train(spark, sf), plan), "u", "i")
    return query


def _impute_sql(fill: str | None) -> str:
    """Column z is 25 percent missing and goes."""
    keep = [c for c in TRAIN_COLUMNS if c != "z"]
    if fill is None:
        where = " AND ".join(f"{c} IS NOT NULL" for c in keep)
        return f"WITH {CLEAN_CTE} SELECT obj_id, r, round(u,8) AS u, round(i,8) AS i, g, gini, z_spec FROM trainc WHERE {where}"
    def value(c):
        return f"round(coalesce({c}, {fill.format(c=c)}),8) AS {c}" if c in ("u", "i") else c
    return f"WITH {CLEAN_CTE} SELECT obj_id, {', '.join(value(c) for c in keep)} FROM trainc"


def split_imputed(spark: SparkSession, sf: str) -> DataFrame:
    """Train and test parts, both filled with the means of the train part."""
    parts = folds.holdout(train(spark, sf), ["obj_id"], 0.2, seed=3)
    a, b = (parts.filter(F.col("part") == p) for p in ("train", "test"))
    a, b, _ = impute.preprocess(a, b, "mean", keep=["obj_id"], protect=["z_spec"])
    return rounded(a.unionByName(b), "u", "i")


# --- folds ---------------------------------------------------------------------------------

def mixed_sql(key: str, seed: int) -> str:
    x = f"((({key}%{MODULUS})*{MULTIPLIER}+{seed * SEED_STEP + 1})%{MODULUS})"
    square = f"({x}*{x}%{MODULUS})"
    return f"({square}*{square}%{MODULUS}*{x}%{MODULUS})"


LIMIT = int(0.2 * MODULUS)


def contiguous(spark: SparkSession, sf: str) -> DataFrame:
    return folds.contiguous_folds(train(spark, sf).select("obj_id"), "obj_id", 4)


# --- scaling -------------------------------------------------------------------------------

def scaled(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        t = view(spark, sf, "population").select("obj_id", *BANDS)
        return rounded(scale.fit(t, BANDS, kind).apply(t), *BANDS, digits=6)
    return query


# --- pixels --------------------------------------------------------------------------------

def images(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings read as cut-outs eight pixels wide, in two bands."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", pixels.as_image(F.col("embedding"), 8).alias("image_r"))
    dim = F.transform("image_r", lambda row: F.transform(row, lambda p: (p * 2 - 1).cast("float")))
    return e.withColumn("image_i", dim)


def mask_pixels(spark: SparkSession, sf: str) -> DataFrame:
    masked = images(spark, sf).select("vec_id", F.flatten(pixels.mask_bad(F.col("image_i"))).alias("p"))
    return masked.select("vec_id", F.transform("p", lambda x: F.round(x.cast("double"), 6)).alias("pixels"))


def stack_pixels(spark: SparkSession, sf: str) -> DataFrame:
    stacked = images(spark, sf).select("vec_id", pixels.stack_bands([F.col("image_r"), F.col("image_i")]).alias("s"))
    flat = F.flatten(F.flatten("s"))
    return stacked.select("vec_id", F.transform(flat, lambda x: F.round(x.cast("double"), 6)).alias("pixels"))


def pixel_scale(spark: SparkSession, sf: str) -> DataFrame:
    scale = pixels.pixel_scales(images(spark, sf), ["image_r"])["image_r"]
    counted = images(spark, sf).agg(F.sum(F.size(F.flatten("image_r"))).alias("n"))
    return counted.withColumn("scale", F.round(F.lit(scale), 8))


def stretch(spark: SparkSession, sf: str) -> DataFrame:
    """Stretched cut-outs, with the scale of the train part."""
    parts = folds.holdout(images(spark, sf), ["vec_id"], 0.2)
    a, b = (parts.filter(F.col("part") == p) for p in ("train", "test"))
    done = pixels.prepare_images(a, [b], ["image_r"])
    out = done[0].unionByName(done[1])
    return out.select("vec_id", "part", F.transform(F.flatten("image_r"), lambda x: F.round(x, 5)).alias("pixels"))


PIXEL_CTE = "px AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS p FROM embeddings)"


def _scale_sql(source: str) -> str:
    return (f"m AS (SELECT median(p) AS m FROM {source}),"
            f" sc AS (SELECT median(abs(p-m))*1.482602218505602e0 AS scale FROM {source}, m)")


QUERIES = {
    "hist1d": lambda s, d: _hist(s, d),
    "hist1d_density": lambda s, d: _hist(s, d, density=True),
    "hist2d_colours": colour_colour,
    "hist2d_redshift": lambda s, d: histogram.histogram2d(pred(s, d), "y_test", "y_pred"),
    "column_range": lambda s, d: histogram.column_range(clean(s, d), "u"),
    "medians": medians,
    "corr_matrix": lambda s, d: rounded(statistics.correlation_matrix(clean(s, d), TRAIN_COLUMNS), "corr"),
    "missing_ratio": lambda s, d: rounded(statistics.missing_report(clean(s, d)), "missing_percent"),
    "sigma_eta": sigma_eta,
    "fold_scores": fold_scores,
    "fold_summary": fold_summary,
    "best_fold": lambda s, d: fold_scores(s, d).agg(F.min_by("fold", "score").alias("fold"), F.min("score").alias("score")),
    "weights_band": lambda s, d: rounded(weights.band_weights(clean(s, d), view(s, d, "population"), ["obj_id"], "r"), "weight"),
    "weights_missing": lambda s, d: rounded(weights.band_weights(clean(s, d), view(s, d, "population"), ["obj_id"], "u"), "weight"),
    "weights_mean": lambda s, d: rounded(
        weights.mean_weights(clean(s, d), view(s, d, "population"), ["obj_id"], ["r", "u", "i", "g"]), "weight"),
    "colours": lambda s, d: project.colours(train(s, d), BANDS, ORDER).withColumns(
        {f"{a}-{b}": F.round(f"`{a}-{b}`", 8) for a, b in zip(ORDER, ORDER[1:])}),
    "colour_orders": colour_orders,
    "uncommon_letters": letters,
    "band_subsets": subset_means,
    "training_sentinels": clean,
    "drop_sparse_columns": lambda s, d: clean(s, d).drop(*impute.sparse_columns(clean(s, d), TRAIN_COLUMNS)),
    "impute_drop": imputed("drop"),
    "impute_mean": imputed("mean"),
    "impute_mode": imputed("mode"),
    "impute_median": imputed("median"),
    "impute_constant": imputed(20.0),
    "impute_none": imputed(None),
    "impute_split": split_imputed,
    "folds_shuffled": lambda s, d: folds.shuffled_folds(train(s, d).select("obj_id"), ["obj_id"], 4, seed=1),
    "folds_shuffled_exact": lambda s, d: folds.shuffled_folds(train(s, d).select("obj_id"), ["obj_id"], 4, seed=1, exact=True),
    "folds_contiguous": contiguous,
    "holdout": lambda s, d: folds.holdout(train(s, d).select("obj_id"), ["obj_id"], 0.2, 0, validation=True),
    "shuffle_column": lambda s, d: folds.shuffle_column(train(s, d).select("obj_id", "r", "g"), ["obj_id"], "g", seed=2, group_rows=500),
    "scale_standard": scaled("standard"),
    "scale_robust": scaled("robust"),
    "mask_pixels": mask_pixels,
    "stack_bands": stack_pixels,
    "pixel_scale": pixel_scale,
    "arcsinh_stretch": stretch,
}

_ROBUST = ", ".join(
    f"round(({b}-quantile_cont({b},5e-1) OVER ())/(quantile_cont({b},7.5e-1) OVER ()-quantile_cont({b},2.5e-1) OVER ()),6) AS {b}"
    for b in BANDS
)
_STANDARD = ", ".join(f"round(({b}-avg({b}) OVER ())/stddev_pop({b}) OVER (),6) AS {b}" for b in BANDS)
_PAIRS = [(a, b) for a in TRAIN_COLUMNS for b in TRAIN_COLUMNS]

ORACLES = {
    "hist1d": f"WITH {CLEAN_CTE}, {_bins_sql('trainc', 'z_spec', 50)} SELECT bin, lower, upper, cnt FROM h",
    "hist1d_density": f"WITH {CLEAN_CTE}, {_bins_sql('trainc', 'z_spec', 50)} SELECT bin, lower, upper, cnt,"
                      " round(cnt/((SELECT sum(cnt) FROM h)*step),8) AS density FROM h",
    "hist2d_colours": f"WITH {CLEAN_CTE}, s AS (SELECT r-i AS ri, u-r AS ur FROM trainc WHERE i IS NOT NULL AND u IS NOT NULL),"
                      f" {_bin2_sql('ri', 'ur')}",
    "hist2d_redshift": f"WITH {ctes('pred')}, s AS (SELECT * FROM pred), {_bin2_sql('y_test', 'y_pred')}",
    "column_range": f"WITH {CLEAN_CTE} SELECT min(u) AS lo, max(u) AS hi, count(u) AS total FROM trainc",
    "medians": f"WITH {CLEAN_CTE} SELECT count(*) AS n, " + ", ".join(f"median({c}) AS {c}" for c in TRAIN_COLUMNS) + " FROM trainc",
    "corr_matrix": f"WITH {CLEAN_CTE} " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),8) AS corr FROM trainc" for a, b in _PAIRS),
    "missing_ratio": f"WITH {CLEAN_CTE}, m AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END)*1e2,8) AS missing_percent FROM trainc"
        for c in TRAIN_COLUMNS) + ") SELECT * FROM m WHERE missing_percent>0 ORDER BY missing_percent DESC LIMIT 30",
    "sigma_eta": f"WITH {SCORE_CTE}, m AS (SELECT median(dz) AS m, avg(dz) AS b FROM d), s AS (SELECT count(*) AS n,"
                 f" {SIGMA} AS sigma, avg(CASE WHEN abs(dz)>1.5e-1 THEN 1e0 ELSE 0e0 END) AS eta, min(b) AS bias FROM d, m)"
                 " SELECT n, round(sigma,8) AS sigma, round(eta,8) AS eta, round(bias,8) AS bias,"
                 " round(sqrt(bias*bias+sigma*sigma),8) AS score, round(sigma+eta,8) AS total FROM s",
    "fold_scores": f"WITH {FOLD_CTE} SELECT fold, n, round(sigma,8) AS sigma, round(eta,8) AS eta, round(score,8) AS score FROM ft",
    "fold_summary": f"WITH {FOLD_CTE}, z AS (SELECT count(*) AS folds, avg(score) AS s, stddev_pop(score)/sqrt(count(*)) AS e FROM ft)"
                    " SELECT folds, round(s,8) AS score, round(e,8) AS error, printf('%.3f+-%.3f', s, e) AS report FROM z",
    "best_fold": f"WITH {FOLD_CTE} SELECT fold, round(score,8) AS score FROM ft ORDER BY score LIMIT 1",
    "weights_band": f"WITH {CLEAN_CTE}, {ctes('population')}, {_weight_sql('r', 'wr')} SELECT obj_id, round(weight,8) AS weight FROM wr",
    "weights_missing": f"WITH {CLEAN_CTE}, {ctes('population')}, {_weight_sql('u', 'wu')} SELECT obj_id, round(weight,8) AS weight FROM wu",
    "weights_mean": f"WITH {CLEAN_CTE}, {ctes('population')}, " + ", ".join(_weight_sql(c, f"w{c}") for c in "ruig")
                    + " SELECT obj_id, round((wr.weight+wu.weight+wi.weight+wg.weight)/4e0,8) AS weight"
                      " FROM wr JOIN wu USING (obj_id) JOIN wi USING (obj_id) JOIN wg USING (obj_id)",
    "colours": f"WITH {ctes('train')} SELECT obj_id, r, " + ", ".join(
        f'round({a}-{b},8) AS "{a}-{b}"' for a, b in zip(ORDER, ORDER[1:])) + ", gini, z_spec FROM train",
    "colour_orders": _colour_orders_sql(),
    "uncommon_letters": "WITH p AS (SELECT p_partkey, lower(regexp_replace(p_name,'[^A-Za-z]','','g')) AS a,"
                        " lower(regexp_replace(p_type,'[^A-Za-z]','','g')) AS b FROM part),"
                        " al AS (SELECT chr(CAST(97+x AS INTEGER)) AS l FROM range(26) t(x))"
                        " SELECT p_partkey, coalesce(string_agg(l, '' ORDER BY l) FILTER (WHERE contains(a,l)<>contains(b,l)),'') AS letters"
                        " FROM p, al GROUP BY p_partkey",
    "band_subsets": _subset_sql(),
    "training_sentinels": f"WITH {CLEAN_CTE} SELECT * FROM trainc",
    "drop_sparse_columns": f"WITH {CLEAN_CTE} SELECT obj_id, r, u, i, g, gini, z_spec FROM trainc",
    "impute_drop": _impute_sql(None),
    "impute_mean": _impute_sql("(SELECT avg({c}) FROM trainc)"),
    "impute_mode": _impute_sql("(SELECT {c} FROM trainc WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"),
    "impute_median": _impute_sql("(SELECT median({c}) FROM trainc)"),
    "impute_constant": _impute_sql("2e1"),
    "impute_none": f"WITH {ctes('train')} SELECT obj_id, r, round(u,8) AS u, round(i,8) AS i, z, g, gini, z_spec FROM train",
    "impute_split": f"WITH {CLEAN_CTE}, q AS (SELECT *, CASE WHEN {mixed_sql('obj_id', 3)}<{LIMIT} THEN 'test' ELSE 'train' END AS part FROM trainc)"
                    " SELECT obj_id, r, round(coalesce(u,(SELECT avg(u) FROM q WHERE part='train')),8) AS u,"
                    " round(coalesce(i,(SELECT avg(i) FROM q WHERE part='train')),8) AS i, g, gini, z_spec, part FROM q",
    "folds_shuffled": f"WITH {ctes('train')} SELECT obj_id, CAST(floor({mixed_sql('obj_id', 1)}*4/{MODULUS}e0) AS INTEGER) AS fold FROM train",
    "folds_shuffled_exact": f"WITH {ctes('train')} SELECT obj_id, CAST(least(3, (row_number() OVER (ORDER BY {mixed_sql('obj_id', 1)})-1)"
                            " // ((SELECT count(*) FROM train)//4)) AS INTEGER) AS fold FROM train",
    "folds_contiguous": f"WITH {ctes('train')} SELECT obj_id, CAST(least(3, (row_number() OVER (ORDER BY obj_id)-1)"
                        " // ((SELECT count(*) FROM train)//4)) AS INTEGER) AS fold FROM train",
    "holdout": f"WITH {ctes('train')} SELECT obj_id, CASE WHEN {mixed_sql('obj_id', 0)}<{LIMIT} THEN 'test'"
               f" WHEN {mixed_sql('obj_id', 1)}<{LIMIT} THEN 'validation' ELSE 'train' END AS part FROM train",
    "shuffle_column": f"WITH {ctes('train')}, q AS (SELECT obj_id, r, g, CAST(floor({mixed_sql('obj_id', 2)}"
                      f"*CAST(ceil((SELECT count(*) FROM train)/5e2) AS BIGINT)/{MODULUS}e0) AS INTEGER) AS grp,"
                      f" {mixed_sql('obj_id', 7921)} AS turn FROM train)"
                      " SELECT obj_id, r, coalesce(lead(g) OVER (PARTITION BY grp ORDER BY turn, obj_id),"
                      " first_value(g) OVER (PARTITION BY grp ORDER BY turn, obj_id)) AS g FROM q",
    "scale_standard": f"WITH {ctes('population')} SELECT obj_id, {_STANDARD} FROM population",
    "scale_robust": f"WITH {ctes('population')} SELECT obj_id, {_ROBUST} FROM population",
    "mask_pixels": "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(CASE WHEN CAST(x*2-1 AS FLOAT)>-1 THEN CAST(x*2-1 AS FLOAT)"
                   " ELSE CAST(0 AS FLOAT) END AS DOUBLE),6)) AS pixels FROM embeddings",
    "stack_bands": "SELECT vec_id, flatten(list_transform(embedding, lambda x: [round(CAST(x AS DOUBLE),6),"
                   " round(CAST(CAST(x*2-1 AS FLOAT) AS DOUBLE),6)])) AS pixels FROM embeddings",
    "pixel_scale": f"WITH {PIXEL_CTE}, {_scale_sql('px')} SELECT CAST((SELECT count(*) FROM px) AS BIGINT) AS n, round(scale,8) AS scale FROM sc",
    "arcsinh_stretch": f"WITH {PIXEL_CTE}, tr AS (SELECT * FROM px WHERE NOT ({mixed_sql('vec_id', 0)}<{LIMIT})), {_scale_sql('tr')}"
                       f" SELECT vec_id, CASE WHEN {mixed_sql('vec_id', 0)}<{LIMIT} THEN 'test' ELSE 'train' END AS part,"
                       " list_transform(embedding, lambda x: round(asinh(CAST(x AS DOUBLE)/sc.scale),5)) AS pixels FROM embeddings, sc",
}
