"""Folds, scores, partial least squares and its cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import above_median
from cohortloom.operators import folds, pls, ranks, scores
from cohortloom.operators.crossval import run_plsr_cv
from cohortloom.plans.panel import measure_panel, read, survey_panel, with_panel
from cohortloom.staging import broadcast_if_small, stage

X_VARS = ["x_qty", "x_disc", "x_tax", "x_order"]
COVARIATES = ["cov_bal", "cov_prio"]
PREDICTORS = X_VARS + COVARIATES


def kfold(spark, sf_dir):
    return folds.assign_folds(survey_panel(spark, sf_dir).select("sample"), 8, seed=42)


def nested_folds(spark, sf_dir):
    return folds.nested_folds(survey_panel(spark, sf_dir).select("sample"), 8, 7, seed=42)


def fold_median(spark, sf_dir):
    panel = folds.assign_folds(measure_panel(spark, sf_dir), 8, seed=42)
    return ranks.exact_median(panel, ["fold"], "y_price").withColumn("median", F.round("median", 4))


def median_binarise(spark, sf_dir):
    panel = measure_panel(spark, sf_dir).select("sample", "Cycle", "y_price")
    medians = stage(ranks.exact_median(panel, ["Cycle"], "y_price"), "medians")
    return panel.join(broadcast_if_small(medians), "Cycle").select(
        "sample", above_median(F.col("y_price"), F.col("median")).alias("label"))


def auroc(spark, sf_dir):
    """Per fold: how well the order total ranks prices above the fold's median."""
    panel = folds.assign_folds(measure_panel(spark, sf_dir), 8, seed=42).select("fold", "y_total", "x_qty")
    panel = stage(panel, "scored")
    medians = stage(ranks.exact_median(panel, ["fold"], "y_total"), "medians")
    labelled = panel.join(broadcast_if_small(medians), "fold").select(
        "fold", above_median(F.col("y_total"), F.col("median")).alias("label"), F.col("x_qty").alias("score"))
    return ranks.auroc(labelled, ["fold"]).withColumn("auroc", F.round("auroc", 6))


def auroc_by_language(spark, sf_dir):
    """Text length as a score of the quality labels; a language with one class scores a half."""
    labels = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    scored = labels.select(F.col("lang"), F.col("quality").alias("label"), F.col("n_chars").alias("score"))
    return ranks.auroc(scored, ["lang"]).withColumn("auroc", F.round("auroc", 6))


def auroc_missing_scores(spark, sf_dir):
    """Scores that some orders lack: a missing one is below all others and tied with its like."""
    panel = survey_panel(spark, sf_dir).select(
        "x_prio", (F.col("sample") % 3 == 0).cast("int").alias("label"), F.col("x_qty").alias("score"))
    return ranks.auroc(panel, ["x_prio"]).withColumn("auroc", F.round("auroc", 6))


def _scores(spark, sf_dir):
    """A table of the shape of inner scores: years as repetitions, priorities as folds."""
    return survey_panel(spark, sf_dir).groupBy(
        F.col("Cycle").alias("rep"), F.col("x_prio").alias("outer"), F.col("cov_nation").alias("inner"),
        (F.col("cov_nation") % 5 + 1).alias("n_components"),
    ).agg(F.round(F.avg("x_gap"), 10).alias("auroc"))


def score_summary(spark, sf_dir):
    table = scores.score_summary(_scores(spark, sf_dir), ["n_components"])
    return table.select("n_components", F.round("mean_score", 10).alias("mean_score"),
                        F.round("std_score", 9).alias("std_score"), "n")


def score_summary_by_fold(spark, sf_dir):
    table = scores.score_summary(_scores(spark, sf_dir), ["outer"])
    return table.select("outer", F.round("mean_score", 10).alias("mean_score"),
                        F.round("std_score", 9).alias("std_score"), "n")


def best_components(spark, sf_dir):
    return scores.best_components(_scores(spark, sf_dir).where(F.col("auroc").isNotNull())).withColumn(
        "mean_score", F.round("mean_score", 10))


def component_frequency(spark, sf_dir):
    chosen = scores.best_components(_scores(spark, sf_dir).where(F.col("auroc").isNotNull()))
    return scores.component_frequency(chosen).select(
        "n_components", "n", F.col("first.rep").alias("first_rep"), F.col("first.outer").alias("first_outer"))


def mode_components(spark, sf_dir):
    chosen = scores.best_components(_scores(spark, sf_dir).where(F.col("auroc").isNotNull()))
    return scores.mode_components(chosen)


def _two_components(spark, sf_dir):
    panel = stage(measure_panel(spark, sf_dir), "measures")
    models, scaling = pls.fit_table(panel, PREDICTORS, ["y_price"], 2)
    return panel, stage(models, "models"), scaling


def pls_weights(spark, sf_dir):
    _, models, _ = _two_components(spark, sf_dir)
    return pls.loadings_table(models, PREDICTORS, "x_weight").select(
        "component", "variable", F.round("loading", 6).alias("weight"))


def pls_loadings(spark, sf_dir):
    _, models, _ = _two_components(spark, sf_dir)
    return pls.loadings_table(models, PREDICTORS).select(
        "component", "variable", F.round("loading", 6).alias("loading"))


def pls_y_loadings(spark, sf_dir):
    _, models, _ = _two_components(spark, sf_dir)
    return pls.loadings_table(models, ["y_price"], "y_loading").select(
        "component", "variable", F.round("loading", 6).alias("loading"))


def top_loadings(spark, sf_dir):
    _, models, _ = _two_components(spark, sf_dir)
    return scores.top_loadings(pls.loadings_table(models, PREDICTORS), n=4).select(
        "variable", F.round("loading", 6).alias("loading"))


def pls_scores(spark, sf_dir):
    panel, models, scaling = _two_components(spark, sf_dir)
    scored = pls.transform(panel, models, scaling, PREDICTORS, 2, panel.count())
    return scored.select("sample", F.round("score_1", 6).alias("t1"), F.round("score_2", 6).alias("t2"))


def pls_predict(spark, sf_dir):
    panel, models, scaling = _two_components(spark, sf_dir)
    return pls.predict(panel, models, scaling, PREDICTORS, ["y_price"], 2).select(
        "sample", F.round("pred_y_price", 4).alias("predicted"))


def explained_variance(spark, sf_dir):
    _, models, _ = _two_components(spark, sf_dir)
    return models.where((F.col("outer") == 0) & (F.col("inner") == 0)).select(
        F.col("n_components").alias("component"), F.round("x_explained", 6).alias("x_explained"),
        F.round("y_explained", 6).alias("y_explained"))


def _one_component_cv(spark, sf_dir):
    return run_plsr_cv(measure_panel(spark, sf_dir), X_VARS, ["y_price"], COVARIATES, [1], 8, 7, seed=42)


def pls_cv_inner(spark, sf_dir):
    return _one_component_cv(spark, sf_dir).inner_scores.withColumn("auroc", F.round("auroc", 6))


def pls_cv_outer(spark, sf_dir):
    return _one_component_cv(spark, sf_dir).outer_scores.withColumn("auroc", F.round("auroc", 6))


def _full_cv(spark, sf_dir):
    return run_plsr_cv(measure_panel(spark, sf_dir), X_VARS, ["y_price", "y_total"], COVARIATES, [1, 2, 3], 8, 7, n_repetitions=2)


def pls_cv(spark, sf_dir):
    """Two repetitions with two outcomes: outer scores with the chosen component counts."""
    return _full_cv(spark, sf_dir).outer_scores


def pls_final(spark, sf_dir):
    """Loadings of the final model and of the best fold's model."""
    result = _full_cv(spark, sf_dir)
    final = pls.loadings_table(result.final_model(), result.x_vars).withColumn("model", F.lit("final"))
    best = pls.loadings_table(result.best_model(), result.x_vars).withColumn("model", F.lit("best fold"))
    return final.unionByName(best).select("model", "component", "variable", "loading")


QUERIES = {f.__name__: f for f in (
    kfold, nested_folds, fold_median, median_binarise, auroc, auroc_by_language, score_summary,
    auroc_missing_scores, score_summary_by_fold, best_components, component_frequency, mode_components, pls_weights, pls_loadings,
    pls_y_loadings, top_loadings, pls_scores, pls_predict, explained_variance, pls_cv_inner, pls_cv_outer,
    pls_cv, pls_final,
)}

_KEY = "md5('42:' || sample)"
_FOLDED = f"folded AS (SELECT sample, NTILE(8) OVER (ORDER BY {_KEY}, sample)::INTEGER AS fold FROM mpanel)"
_NESTED = f"""nested AS (SELECT sample, o::INTEGER AS outer_fold,
    NTILE(7) OVER (PARTITION BY o ORDER BY {_KEY}, sample)::INTEGER AS inner_fold
    FROM folded, (SELECT unnest(range(1, 9)) AS o) WHERE fold <> o)"""


def _auroc(source: str, keys: str) -> str:
    return f"""SELECT {keys}, ROUND(CASE WHEN SUM(label) IN (0, COUNT(*)) THEN 0.5 ELSE
        (SUM(CASE WHEN label = 1 THEN place ELSE 0 END) - SUM(label) * (SUM(label) + 1) / 2.0::DOUBLE)
        / (SUM(label)::DOUBLE * (COUNT(*) - SUM(label))::DOUBLE) END, 6) AS auroc
        FROM (SELECT *, RANK() OVER (PARTITION BY {keys} ORDER BY score)
              + (COUNT(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::DOUBLE AS place FROM {source})
        GROUP BY {keys}"""


_SCORES = """scores AS (SELECT "Cycle" AS rep, x_prio AS "outer", cov_nation AS "inner",
    (cov_nation % 5 + 1)::INTEGER AS n_components, ROUND(AVG(x_gap), 10) AS auroc FROM panel GROUP BY ALL)"""
_CHOSEN = """chosen AS (SELECT rep, "outer", n_components, mean_score FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY rep, "outer" ORDER BY mean_score DESC, n_components) AS place FROM (
      SELECT rep, "outer", n_components, ROUND(AVG(auroc), 12) AS mean_score FROM scores WHERE auroc IS NOT NULL
      GROUP BY ALL)) WHERE place = 1)"""

# Two components by deflation, on a long table of standardised columns.
_DEFLATION = [
    "z1 AS (" + " UNION ALL ".join(
        f"""SELECT sample, '{x}' AS v, ({x} - AVG({x}) OVER ()) / STDDEV_SAMP({x}) OVER () AS x FROM mpanel"""
        for x in PREDICTORS) + ")",
    """y1 AS (SELECT sample, (y_price - AVG(y_price) OVER ()) / STDDEV_SAMP(y_price) OVER () AS y FROM mpanel)""",
]
for _a in (1, 2):
    _DEFLATION += [
        f"""c{_a} AS (SELECT v, SUM(x * y) AS c FROM z{_a} JOIN y{_a} USING (sample) GROUP BY v)""",
        f"""w{_a} AS (SELECT v, c / (SELECT SQRT(SUM(c * c)) FROM c{_a})
            * (SELECT SIGN(arg_max(c, ABS(c))) FROM c{_a}) AS w FROM c{_a})""",
        f"""t{_a} AS (SELECT sample, SUM(x * w) AS t FROM z{_a} JOIN w{_a} USING (v) GROUP BY sample)""",
        f"""p{_a} AS (SELECT v, SUM(x * t) / (SELECT SUM(t * t) FROM t{_a}) AS p
            FROM z{_a} JOIN t{_a} USING (sample) GROUP BY v)""",
        f"""q{_a} AS (SELECT SUM(y * t) / SUM(t * t) AS q FROM y{_a} JOIN t{_a} USING (sample))""",
        f"""z{_a + 1} AS (SELECT sample, v, x - t * p AS x FROM z{_a} JOIN t{_a} USING (sample) JOIN p{_a} USING (v))""",
        f"""y{_a + 1} AS (SELECT sample, y - t * q AS y FROM y{_a} JOIN t{_a} USING (sample), q{_a})""",
    ]


def _both(body: str) -> str:
    return " UNION ALL ".join(body.format(a=a) for a in (1, 2))


_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT sample, '{x}' AS v, {x}::DOUBLE AS x, y_price AS y FROM mpanel" for x in PREDICTORS) + ")"


def _weights(source: str, keys: str) -> list[str]:
    """One-component weights per training set, in units of the raw columns."""
    return [
        f"""trained AS (SELECT {keys}, v, STDDEV_SAMP(x) AS s, CORR(x, y) AS c
            FROM {source} GROUP BY {keys}, v)""",
        f"""weighted AS (SELECT {keys}, v, c / s / SQRT(SUM(c * c) OVER (PARTITION BY {keys})) AS w FROM trained)""",
    ]


ORACLES = {
    "kfold": with_panel(
        f"SELECT sample, NTILE(8) OVER (ORDER BY {_KEY}, sample)::INTEGER AS fold FROM panel"),
    "nested_folds": with_panel("SELECT * FROM nested", _FOLDED, _NESTED),
    "fold_median": with_panel(
        "SELECT fold, ROUND(MEDIAN(y_price), 4) AS median FROM mpanel JOIN folded USING (sample) GROUP BY fold",
        _FOLDED),
    "median_binarise": with_panel("""SELECT sample, (y_price > m)::INTEGER AS label FROM mpanel JOIN
        (SELECT "Cycle", MEDIAN(y_price) AS m FROM mpanel GROUP BY "Cycle") USING ("Cycle")"""),
    "auroc": with_panel(
        _auroc("labelled", "fold"), _FOLDED,
        """labelled AS (SELECT fold, (y_total > MEDIAN(y_total) OVER (PARTITION BY fold))::INTEGER AS label,
           x_qty AS score FROM mpanel JOIN folded USING (sample))"""),
    "auroc_by_language": "WITH labelled AS (SELECT lang, quality AS label, n_chars AS score FROM labels "
                         "JOIN documents USING (doc_id)) " + _auroc("labelled", "lang"),
    "score_summary": with_panel("""SELECT n_components, ROUND(AVG(auroc), 10) AS mean_score,
        ROUND(STDDEV_POP(auroc), 9) AS std_score, COUNT(auroc) AS n FROM scores GROUP BY n_components""", _SCORES),
    "score_summary_by_fold": with_panel("""SELECT "outer", ROUND(AVG(auroc), 10) AS mean_score,
        ROUND(STDDEV_POP(auroc), 9) AS std_score, COUNT(auroc) AS n FROM scores GROUP BY "outer" """, _SCORES),
    "auroc_missing_scores": with_panel("""SELECT x_prio, ROUND(SUM(CASE WHEN label = 1 THEN below + equal / 2.0 END)
          / (SUM(label) * SUM(1 - label)), 6) AS auroc
        FROM (SELECT x_prio, label, SUM(1 - label) OVER (PARTITION BY x_prio ORDER BY score NULLS FIRST
            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - SUM(1 - label) OVER (PARTITION BY x_prio, score) AS below,
          SUM(1 - label) OVER (PARTITION BY x_prio, score) AS equal
          FROM (SELECT x_prio, CASE WHEN sample % 3 = 0 THEN 1 ELSE 0 END AS label, x_qty AS score FROM panel))
        GROUP BY x_prio"""),
    "best_components": with_panel(
        'SELECT rep, "outer", n_components, ROUND(mean_score, 10) AS mean_score FROM chosen', _SCORES, _CHOSEN),
    "component_frequency": with_panel("""SELECT n_components, COUNT(*) AS n, MIN(rep) AS first_rep,
        arg_min("outer", rep * 1000 + "outer") AS first_outer FROM chosen GROUP BY n_components""", _SCORES, _CHOSEN),
    "mode_components": with_panel("""SELECT n_components, COUNT(*) AS n FROM chosen GROUP BY n_components
        ORDER BY n DESC, MIN(rep * 1000 + "outer") LIMIT 1""", _SCORES, _CHOSEN),
    "pls_weights": with_panel(
        _both("SELECT {a}::INTEGER AS component, v AS variable, ROUND(w, 6) AS weight FROM w{a}"), *_DEFLATION),
    "pls_loadings": with_panel(
        _both("SELECT {a}::INTEGER AS component, v AS variable, ROUND(p, 6) AS loading FROM p{a}"), *_DEFLATION),
    "pls_y_loadings": with_panel(
        _both("SELECT {a}::INTEGER AS component, 'y_price' AS variable, ROUND(q, 6) AS loading FROM q{a}"),
        *_DEFLATION),
    "top_loadings": with_panel(
        "SELECT v AS variable, ROUND(p, 6) AS loading FROM p1 ORDER BY ABS(p) DESC, v LIMIT 4", *_DEFLATION),
    "pls_scores": with_panel(
        "SELECT sample, ROUND(t1.t, 6) AS t1, ROUND(t2.t, 6) AS t2 FROM t1 JOIN t2 USING (sample)", *_DEFLATION),
    "pls_predict": with_panel(
        """SELECT sample, ROUND(m + s * (q1.q * t1.t + q2.q * t2.t), 4) AS predicted
           FROM t1 JOIN t2 USING (sample), q1, q2,
           (SELECT AVG(y_price) AS m, STDDEV_SAMP(y_price) AS s FROM mpanel)""", *_DEFLATION),
    "explained_variance": with_panel(
        _both("""SELECT {a}::INTEGER AS component, ROUND(VAR_POP(t) / 6, 6) AS x_explained,
            ROUND(ANY_VALUE(q) * ANY_VALUE(q) * SUM(t * t) / (SELECT SUM(y * y) FROM y1), 6) AS y_explained
            FROM t{a}, q{a}"""), *_DEFLATION),
    "pls_cv_inner": with_panel(
        _auroc("labelled", 'rep, "outer", "inner", n_components'),
        _FOLDED, _NESTED, _LONG,
        """spread AS (SELECT outer_fold AS o, i, v, x, y FROM nested JOIN long USING (sample),
           (SELECT unnest(range(1, 8))::INTEGER AS i) WHERE inner_fold <> i)""",
        *_weights("spread", "o, i"),
        """scored AS (SELECT sample, o, i, SUM(x * w) AS score, ANY_VALUE(y) AS y FROM nested JOIN long USING (sample)
           JOIN weighted ON o = outer_fold AND i = inner_fold AND weighted.v = long.v GROUP BY sample, o, i)""",
        """labelled AS (SELECT 1::INTEGER AS rep, o AS "outer", i AS "inner", 1::INTEGER AS n_components,
           (y > MEDIAN(y) OVER (PARTITION BY o, i))::INTEGER AS label, score FROM scored)"""),
    "pls_cv_outer": with_panel(
        _auroc("labelled", 'rep, "outer", n_components'),
        _FOLDED, _LONG,
        """spread AS (SELECT o, v, x, y FROM folded JOIN long USING (sample),
           (SELECT unnest(range(1, 9))::INTEGER AS o) WHERE fold <> o)""",
        *_weights("spread", "o"),
        """scored AS (SELECT sample, o, SUM(x * w) AS score, ANY_VALUE(y) AS y FROM folded JOIN long USING (sample)
           JOIN weighted ON o = fold AND weighted.v = long.v GROUP BY sample, o)""",
        """labelled AS (SELECT 1::INTEGER AS rep, o AS "outer", 1::INTEGER AS n_components,
           (y > MEDIAN(y) OVER (PARTITION BY o))::INTEGER AS label, score FROM scored)"""),
}
