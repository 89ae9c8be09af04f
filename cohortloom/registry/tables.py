"""Reading, selecting, merging and transforming tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import log2_offset, nan_to_null, parse_measure
from cohortloom.operators import merge, select, transform
from cohortloom.operators.histogram import histogram
from cohortloom.operators.moments import correlation, whole_correlation
from cohortloom.plans.clean import clean_cohort as run_clean
from cohortloom.plans.panel import measure_panel, read, survey_panel, with_panel
from cohortloom.sources import cohort
from cohortloom.staging import new_path

CATEGORIES = ["ECONOMY", "PROMO"]
PATTERNS = {"metal": ["ring", "bolt", "gear"], "aged": ["old"], "colour": ["red", "blue"], "empty": ["zinc"]}


def _raw_measures(spark, sf_dir):
    """Order lines as a long measure table, the variable being the part's key."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("variable"),
        F.col("l_quantity").alias("value"))


def _dictionary(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("var"), F.col("p_type").alias("category"))


def _named_measures(spark, sf_dir):
    """The same with part names as variables."""
    return (
        read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("sample"), F.col("p_name").alias("variable"),
                F.col("l_quantity").alias("value"))
    )


def parse_na(spark, sf_dir):
    """Order totals as text, some priorities written as missing tokens or as what only looks like a number."""
    kind = F.substring("o_orderpriority", 1, 1)
    text = (F.when(kind == "1", "NA").when(kind == "2", " nan ").when(kind == "3", "")
            .when(kind == "4", F.element_at(F.array(F.lit("n/a"), F.lit("1d"), F.lit("12F")), (F.col("o_orderkey") % 3 + 1).cast("int")))
            .otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))))
    return read(spark, sf_dir, "orders").select("o_orderkey", parse_measure(text).alias("value"))


def nan_as_missing(spark, sf_dir):
    value = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return (
        read(spark, sf_dir, "lineitem").select("l_orderkey", nan_to_null(value).alias("discount"))
        .groupBy("l_orderkey").agg(F.count("discount").alias("n"), F.round(F.avg("discount"), 6).alias("mean"))
    )


def cohort_scan(spark, sf_dir):
    """The panel written as two CSV files with missing tokens and read back as a cohort."""
    folder = new_path(spark, "raw")
    panel = survey_panel(spark, sf_dir)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in panel.columns if c != "sample"]
    table = panel.select("sample", F.xxhash64("sample").alias("sequence"), *text)
    half = {"a.csv": ["Cycle", "outcome", "x_qty", "x_price"], "b.csv": ["Cycle", "x_gap", "x_cat"]}
    for name, columns in half.items():
        cohort.write_table(table.select("sample", "sequence", *columns), f"{folder}/{name}", file_format="csv")
    tables = cohort.load_cohort(spark, folder, list(half))
    return tables["data_1"].join(tables["data_2"].drop("Cycle"), "sample")


def dataset_sink(spark, sf_dir):
    """Datasets written to a folder each and read back; the order priority plays the dataset."""
    path = new_path(spark, "datasets")
    panel = survey_panel(spark, sf_dir).select("sample", "Cycle", "x_qty", F.col("x_prio").alias("dataset"))
    cohort.write_datasets(panel, path)
    return spark.read.parquet(path).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("x_qty").alias("n_qty"), F.sum("sample").alias("id_sum"))


def keep_first(spark, sf_dir):
    return select.keep_first(survey_panel(spark, sf_dir), ["x_price", "not_there", "sample", "x_qty"],
                             ["sample", "Cycle"])


def dictionary_select(spark, sf_dir):
    return select.select_long_by_dictionary(
        _raw_measures(spark, sf_dir), _dictionary(spark, sf_dir), CATEGORIES)


def dictionary_columns(spark, sf_dir):
    """The same choice on a wide table: the dictionary lists part types for columns of orders."""
    dictionary = read(spark, sf_dir, "part").select(
        F.when(F.col("p_type") == "PROMO", "o_totalprice").when(F.col("p_type") == "LARGE", "o_custkey")
        .otherwise("unknown").alias("var"), F.col("p_type").alias("category"))
    return select.select_by_dictionary(
        {"main": read(spark, sf_dir, "orders"), "description": dictionary}, ["o_orderkey"], CATEGORIES)


def pattern_blocks(spark, sf_dir):
    return select.assign_blocks(_named_measures(spark, sf_dir), PATTERNS).select(
        "block", "sample", "variable", "value")


def role_difference(spark, sf_dir):
    roles = _dictionary(spark, sf_dir).where(F.col("category").isin(*CATEGORIES))
    return select.drop_long_roles(_raw_measures(spark, sf_dir), roles.withColumnRenamed("var", "variable"))


def seeded_variables(spark, sf_dir):
    measures = _named_measures(spark, sf_dir)
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("variable"))
    chosen = select.sample_variables(names, 10, seed=42)
    return measures.join(select.broadcast_if_small(chosen), "variable", "left_semi").select(
        "variable", "sample", "value")


def _status_summary(spark, sf_dir, status):
    """Per customer the orders of one status: two files that share only some participants."""
    return (
        read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
        .groupBy(F.col("o_custkey").alias("sample")).agg(
            F.min(F.year("o_orderdate")).alias("Cycle"),
            F.when(F.count(F.lit(1)) > 1, F.round(F.sum("o_totalprice"), 2)).alias("spend"),
            F.count(F.lit(1)).alias(f"n_{status.lower()}"),
        )
    )


def outer_merge_coalesce(spark, sf_dir):
    """Three files, one per order status, of which no two hold the same participants."""
    done, open_, partly = (_status_summary(spark, sf_dir, status) for status in "FOP")
    return merge.outer_merge(merge.outer_merge(done, open_), partly)


def harmonise_rename(spark, sf_dir):
    left = survey_panel(spark, sf_dir).select("sample", F.col("outcome").alias("CFDDS"))
    right = survey_panel(spark, sf_dir).select("sample", F.col("x_price").alias("CFDRIGHT"))
    return merge.harmonise_names(left, right)[0]


def inner_merge(spark, sf_dir):
    outcomes = read(spark, sf_dir, "labels").select("doc_id", "quality")
    measures = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return merge.inner_merge(outcomes, measures, on="doc_id")


def reattach_ids(spark, sf_dir):
    panel = survey_panel(spark, sf_dir)
    values = transform.log2_columns(panel.select("sample", "x_qty"), ["x_qty"])
    return merge.reattach(values, panel, ["Cycle"]).select("sample", "Cycle", F.round("x_qty", 6).alias("x_qty"))


def repeated_ids(spark, sf_dir):
    return merge.repeated_ids(read(spark, sf_dir, "lineitem"), on="l_orderkey")


def log2_values(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", (F.col("l_quantity") - 25).alias("shifted"))
    return lines.select("l_orderkey", "l_linenumber", F.round(log2_offset(F.col("l_discount")), 6).alias("discount"),
                        F.round(log2_offset(F.col("shifted")), 6).alias("shifted"))


def standardize(spark, sf_dir):
    panel = survey_panel(spark, sf_dir).select("sample", "cov_bal", "x_qty", "x_price", "x_gap",
                                               F.lit(3.0).alias("constant"))
    result = transform.standardize(panel, panel.columns[1:])
    return result.select("sample", *[F.round(c, 6).alias(c) for c in result.columns[1:]])


def exposure_index(spark, sf_dir):
    panel = survey_panel(spark, sf_dir).select("sample", "x_qty", "x_price", "x_gap")
    result = transform.exposure_index(panel, ["x_qty", "x_price", "x_gap"])
    return result.withColumn("exposure_index", F.round("exposure_index", 6))


def histogram_counts(spark, sf_dir):
    bins = histogram(survey_panel(spark, sf_dir), ["outcome", "x_price"])
    return bins.select("variable", "bin", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "n")


def correlation_matrix(spark, sf_dir):
    panel = survey_panel(spark, sf_dir).withColumn("constant", F.lit(2.5))
    columns = ["outcome", "cov_bal", "x_qty", "x_price", "x_gap", "x_sparse", "x_zero", "constant"]
    return correlation(panel, columns).withColumn("r", F.round("r", 6))


def correlation_full(spark, sf_dir):
    """Both triangles and the diagonal."""
    panel = survey_panel(spark, sf_dir).withColumn("constant", F.lit(2.5))
    columns = ["outcome", "cov_bal", "x_qty", "x_price", "x_gap", "x_sparse", "x_zero", "constant"]
    return whole_correlation(panel, columns).withColumn("r", F.round("r", 6))


def correlation_by_dataset(spark, sf_dir):
    panel = survey_panel(spark, sf_dir).withColumnRenamed("x_prio", "dataset")
    return correlation(panel, ["outcome", "x_qty", "x_price", "x_gap"], ["dataset"]).withColumn("r", F.round("r", 6))


def _raw_cohort(spark, sf_dir):
    panel = survey_panel(spark, sf_dir)
    roles = ["sample", "Cycle", "cov_bal", "cov_nation"]
    return {
        "data_1": panel.select(*roles, F.col("outcome").alias("CFDDS"), "x_qty", "x_price", "x_sparse", "x_gap"),
        "data_2": panel.select(*roles, F.col("x_price").alias("CFDRIGHT"), "x_cat", "x_prio", "x_zero",
                               F.col("outcome").alias("SDDSRVYR")),
    }


def _clean(spark, sf_dir):
    return run_clean(_raw_cohort(spark, sf_dir), covariates=["Cycle", "cov_bal", "cov_nation"])


def clean_cohort(spark, sf_dir):
    combined = _clean(spark, sf_dir).combined
    return combined.select(*[F.round(c, 6).alias(c) if c.startswith("x_") else F.col(c) for c in combined.columns])


def clean_correlation(spark, sf_dir):
    return _clean(spark, sf_dir).exposure_correlation().withColumn("r", F.round("r", 6))


QUERIES = {f.__name__: f for f in (
    parse_na, nan_as_missing, cohort_scan, dataset_sink, keep_first, dictionary_select, dictionary_columns,
    pattern_blocks, role_difference, seeded_variables, outer_merge_coalesce, harmonise_rename, inner_merge,
    reattach_ids, repeated_ids, log2_values, standardize, exposure_index, histogram_counts, correlation_matrix, correlation_full,
    correlation_by_dataset, clean_cohort, clean_correlation,
)}


def _zscore(column: str, name: str, source: str) -> str:
    return (f"SELECT sample, ROUND(CASE WHEN s = 0 THEN 0 ELSE ({column} - m) / s END, 6) AS {name} FROM {source}, "
            f"(SELECT AVG({column}) AS m, STDDEV_POP({column}) AS s FROM {source})")


def _pairs(columns, where=""):
    found = []
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            found.append((a, b))
    return found


def _correlation(columns, source="panel", key=""):
    group = f" GROUP BY {key}" if key else ""
    lead = f"{key}, " if key else ""
    return "\nUNION ALL\n".join(
        f"""SELECT {lead}'{a}' AS var_i, '{b}' AS var_j, n, CASE WHEN n > 1 AND va > 0 AND vb > 0
            THEN ROUND(c, 6) END AS r FROM (SELECT {lead}COUNT(*) AS n, VAR_POP({a}) AS va, VAR_POP({b}) AS vb,
            CASE WHEN COUNT(*) > 1 AND MIN({a}) <> MAX({a}) AND MIN({b}) <> MAX({b}) THEN CORR({a}, {b}) END AS c
            FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL{group})"""
        for a, b in _pairs(columns))


_CLEAN_CTES = (
    """one AS (SELECT sample, "Cycle", cov_bal, cov_nation, outcome AS "CFDDS", LOG2(x_qty + 1e-10) AS lq,
       LOG2(x_price + 1e-10) AS lp FROM panel)""",
    """two AS (SELECT sample, "Cycle", cov_bal, cov_nation, x_price AS "CFDRIGHT", LOG2(x_prio + 1e-10) AS lr
       FROM panel WHERE x_price IS NOT NULL)""",
    """cleaned AS (SELECT o.sample, (o.lq - m.q) / m.qs AS x_qty, (o.lp - m.p) / m.ps AS x_price,
       (t.lr - n.r) / n.rs AS x_prio, o."Cycle", o.cov_bal, o.cov_nation, o."CFDDS"
       FROM one o LEFT JOIN two t USING (sample),
       (SELECT AVG(lq) AS q, STDDEV_POP(lq) AS qs, AVG(lp) AS p, STDDEV_POP(lp) AS ps FROM one) m,
       (SELECT AVG(lr) AS r, STDDEV_POP(lr) AS rs FROM two) n)""",
)

ORACLES = {
    "parse_na": """SELECT o_orderkey, CASE WHEN substring(o_orderpriority, 1, 1) = '5' THEN o_totalprice END AS value
        FROM orders""",
    "nan_as_missing": """SELECT l_orderkey, COUNT(*) FILTER (WHERE l_discount <> 0) AS n,
        ROUND(AVG(l_discount) FILTER (WHERE l_discount <> 0), 6) AS mean FROM lineitem GROUP BY l_orderkey""",
    "cohort_scan": with_panel("""SELECT sample, "Cycle"::DOUBLE AS "Cycle", outcome, x_qty, x_price, x_gap,
        x_cat::DOUBLE AS x_cat FROM panel"""),
    "dataset_sink": with_panel("""SELECT x_prio AS dataset, COUNT(*) AS n_rows, COUNT(x_qty) AS n_qty,
        SUM(sample)::BIGINT AS id_sum FROM panel GROUP BY x_prio"""),
    "keep_first": with_panel('SELECT sample, "Cycle", x_price, x_qty FROM panel'),
    "dictionary_select": """SELECT l_orderkey AS sample, 'P' || l_partkey AS variable, l_quantity AS value
        FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))""",
    "dictionary_columns": "SELECT o_orderkey, o_totalprice FROM orders",
    "pattern_blocks": """SELECT b.block, l_orderkey AS sample, p_name AS variable, l_quantity AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (
          SELECT DISTINCT block, p_name AS name FROM part, (VALUES ('metal', 'ring'), ('metal', 'bolt'),
          ('metal', 'gear'), ('aged', 'old'), ('colour', 'red'), ('colour', 'blue'), ('empty', 'zinc')) v(block, text)
          WHERE contains(p_name, text)) b ON b.name = p_name""",
    "role_difference": """SELECT l_orderkey AS sample, 'P' || l_partkey AS variable, l_quantity AS value
        FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))""",
    "seeded_variables": """SELECT p_name AS variable, l_orderkey AS sample, l_quantity AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name IN (
          SELECT name FROM (SELECT DISTINCT p_name AS name FROM part) ORDER BY md5('42:' || name), name LIMIT 10)""",
    "outer_merge_coalesce": """WITH f AS (SELECT o_custkey AS sample, MIN(year(o_orderdate)) AS cycle,
          CASE WHEN COUNT(*) > 1 THEN ROUND(SUM(o_totalprice), 2) END AS spend, COUNT(*) AS n
          FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
        o AS (SELECT o_custkey AS sample, MIN(year(o_orderdate)) AS cycle,
          CASE WHEN COUNT(*) > 1 THEN ROUND(SUM(o_totalprice), 2) END AS spend, COUNT(*) AS n
          FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey),
        p AS (SELECT o_custkey AS sample, MIN(year(o_orderdate)) AS cycle,
          CASE WHEN COUNT(*) > 1 THEN ROUND(SUM(o_totalprice), 2) END AS spend, COUNT(*) AS n
          FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
        SELECT COALESCE(f.sample, o.sample, p.sample) AS sample, f.n AS n_f, o.n AS n_o, p.n AS n_p,
          COALESCE(f.cycle, o.cycle, p.cycle)::INTEGER AS "Cycle", COALESCE(f.spend, o.spend, p.spend) AS spend
        FROM f FULL OUTER JOIN o ON f.sample = o.sample FULL OUTER JOIN p ON p.sample = COALESCE(f.sample, o.sample)""",
    "harmonise_rename": with_panel('SELECT sample, x_price AS "CFDDS" FROM panel'),
    "inner_merge": """SELECT l.doc_id, quality, n_chars, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "reattach_ids": with_panel("""SELECT sample, "Cycle", ROUND(LOG2(x_qty + 1e-10), 6) AS x_qty FROM panel"""),
    "repeated_ids": "SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1",
    "log2_values": """SELECT l_orderkey, l_linenumber, ROUND(LOG2(l_discount + 1e-10), 6) AS discount,
        CASE WHEN l_quantity - 25 + 1e-10 > 0 THEN ROUND(LOG2(l_quantity - 25 + 1e-10), 6) END AS shifted
        FROM lineitem""",
    "standardize": with_panel(
        """SELECT a.sample, cov_bal, x_qty, x_price, x_gap, 0.0::DOUBLE AS constant
           FROM a JOIN b USING (sample) JOIN c USING (sample) JOIN d USING (sample)""",
        *[f"{t} AS ({_zscore(c, c, 'panel')})" for t, c in
          zip("abcd", ("cov_bal", "x_qty", "x_price", "x_gap"))]),
    "exposure_index": with_panel("""SELECT sample, x_qty, x_price, x_gap, CASE WHEN x_qty IS NOT NULL
        OR x_price IS NOT NULL OR x_gap IS NOT NULL THEN ROUND(COALESCE(x_qty, 0) + COALESCE(x_price, 0)
        + COALESCE(x_gap, 0), 6) END AS exposure_index FROM panel"""),
    "histogram_counts": with_panel(
        """SELECT variable, b AS bin, ROUND(lo + (b - 1) * ((hi - lo) / 10), 4) AS lower,
           ROUND(CASE WHEN b < 10 THEN lo + b * ((hi - lo) / 10) ELSE hi END, 4) AS upper,
           (SELECT COUNT(*) FROM v WHERE v.variable = g.variable AND x IS NOT NULL
            AND LEAST(FLOOR((v.x - lo) / (hi - lo) * 10)::INTEGER, 9) + 1 = b) AS n
           FROM (SELECT DISTINCT variable FROM v) g, (SELECT unnest(range(1, 11))::INTEGER AS b),
           (SELECT MIN(x) AS lo, MAX(x) AS hi FROM v)""",
        """v AS (SELECT 'outcome' AS variable, outcome AS x FROM panel UNION ALL
           SELECT 'x_price', x_price FROM panel)"""),
    "correlation_matrix": with_panel(
        _correlation(["outcome", "cov_bal", "x_qty", "x_price", "x_gap", "x_sparse", "x_zero", "constant"], "wide"),
        "wide AS (SELECT *, 2.5::DOUBLE AS constant FROM panel)"),
    "correlation_full": with_panel(
        "SELECT var_i, var_j, n, r FROM pairs UNION ALL SELECT var_j, var_i, n, r FROM pairs UNION ALL "
        + " UNION ALL ".join(
            f"SELECT '{c}', '{c}', COUNT({c}), CASE WHEN COUNT({c}) >= 2 AND VAR_POP({c}) > 0 THEN 1.0::DOUBLE END FROM wide"
            for c in ["outcome", "cov_bal", "x_qty", "x_price", "x_gap", "x_sparse", "x_zero", "constant"]),
        "wide AS (SELECT *, 2.5::DOUBLE AS constant FROM panel)",
        "pairs AS (" + _correlation(["outcome", "cov_bal", "x_qty", "x_price", "x_gap", "x_sparse", "x_zero", "constant"], "wide") + ")"),
    "correlation_by_dataset": with_panel(
        _correlation(["outcome", "x_qty", "x_price", "x_gap"], "wide", "dataset"),
        "wide AS (SELECT *, x_prio AS dataset FROM panel)"),
    "clean_cohort": with_panel("""SELECT sample, "Cycle", cov_bal, cov_nation, "CFDDS", ROUND(x_qty, 6) AS x_qty,
        ROUND(x_price, 6) AS x_price, ROUND(x_prio, 6) AS x_prio FROM cleaned""", *_CLEAN_CTES),
    "clean_correlation": with_panel(_correlation(["x_qty", "x_price", "x_prio"], "cleaned"), *_CLEAN_CTES),
}
