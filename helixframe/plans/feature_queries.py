"""Projections, filters, class bins and sequence features (2.2, 2.8, A4-A6, S4).

Expression rows come from ``events`` (intensity = 2 * value, dataset =
event_type); sequences from ``documents`` (whole texts); regression pairs
from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import numeric as N
from helixframe.functions import sequence as S
from helixframe.operators import features as X
from helixframe.plans import bindings as B
from helixframe.plans.registry import finish, register
from helixframe.sources.tables import table


def _expr(spark: SparkSession, d: str) -> DataFrame:
    return X.expression_rows(table(spark, d, "events"))


SQL_EXPR = ("expr AS (SELECT event_id, event_type AS dataset, value * 2 AS intensity FROM events)")


def _case_bins(x: str) -> dict[str, str]:
    nan = f"{x} IS NULL OR isnan({x})"
    return {
        "4": f"CASE WHEN {nan} THEN -1 WHEN {x} < 10 THEN 0 WHEN {x} < 100 THEN 1 WHEN {x} < 500 THEN 2 ELSE 3 END",
        "3": f"CASE WHEN {nan} THEN -1 WHEN {x} < 10 THEN 0 WHEN {x} < 100 THEN 1 ELSE 2 END",
        "2": f"CASE WHEN {nan} THEN -1 WHEN {x} < 10 THEN 0 ELSE 1 END",
        "sw": f"CASE WHEN {nan} THEN -1 WHEN {x} < 10 THEN -1 WHEN {x} < 100 THEN 0 ELSE 1 END",
    }


_BINS = _case_bins("intensity")


@register("concat_promoter_gene", sql=f"WITH {B.SQL_DNA} SELECT d.row_id, "
          "d.sequence || (CASE WHEN doc.lang = 'en' THEN NULL ELSE upper(doc.lang) END) AS sequence "
          "FROM dna d JOIN documents doc ON doc.doc_id = d.row_id")
def q_concat_promoter_gene(spark: SparkSession, d: str) -> DataFrame:
    """Promoter + gene; a null part gives null (English rows have no gene)."""
    docs = table(spark, d, "documents")
    genes = F.when(F.col("lang") == "en", F.lit(None)).otherwise(F.upper("lang"))
    return docs.select(F.col("doc_id").alias("row_id"),
                       S.concat_promoter_gene(S.dna_letters("text"), genes).alias("sequence"))


@register("active_filter", sql=f"WITH {SQL_EXPR} SELECT event_id, intensity FROM expr WHERE intensity >= 10")
def q_active_filter(spark: SparkSession, d: str) -> DataFrame:
    return finish(X.active_filter(_expr(spark, d)).select("event_id", "intensity"))


@register("relative_error_filter",
          sql="SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * 1500 AS pred FROM lineitem "
              "WHERE abs(l_extendedprice - l_quantity * 1500) / nullif(l_extendedprice, 0) < 0.1")
def q_relative_error_filter(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"),
                                            (F.col("l_quantity") * 1500).alias("pred"))
    return finish(X.relative_error_filter(li, "y", "pred"))


for _key, _fn, _b in (("bin_intensity_4", N.bin_intensity_4, "4"), ("bin_intensity_3", N.bin_intensity_3, "3"),
                      ("bin_activity_2", N.bin_activity_2, "2"), ("bin_strong_weak", N.bin_strong_weak, "sw")):
    def _q(spark: SparkSession, d: str, _fn=_fn) -> DataFrame:
        return _expr(spark, d).select("event_id", _fn("intensity").alias("intensity_cls"))
    _q.__doc__ = f"{_key}: class of each expression row."
    register(_key, sql=f"WITH {SQL_EXPR} SELECT event_id, {_BINS[_b]} AS intensity_cls FROM expr")(_q)


@register("drop_unassigned", sql=f"WITH {SQL_EXPR} SELECT * FROM (SELECT event_id, {_BINS['sw']} AS intensity_cls "
          "FROM expr) WHERE intensity_cls <> -1")
def q_drop_unassigned(spark: SparkSession, d: str) -> DataFrame:
    """P6 after P14: the strong/weak classes without the unassigned rows."""
    binned = _expr(spark, d).select("event_id", N.bin_strong_weak("intensity").alias("intensity_cls"))
    return X.drop_unassigned(binned)


@register("class_distribution", sql=f"WITH {SQL_EXPR} SELECT {_BINS['4']} AS intensity_cls, count(*) AS n "
          "FROM expr GROUP BY 1")
def q_class_distribution(spark: SparkSession, d: str) -> DataFrame:
    """A5: rows per 4-class bin."""
    return X.class_distribution(_expr(spark, d).withColumn("intensity_cls", N.bin_intensity_4("intensity")))


@register("distinct_class_count", sql=f"WITH {SQL_EXPR} SELECT count(DISTINCT {_BINS['4']}) AS n_classes, "
          f"count(DISTINCT {_BINS['4']}) = 2 AS binary_path FROM expr")
def q_distinct_class_count(spark: SparkSession, d: str) -> DataFrame:
    """Number of distinct labels; 2 selects the binary loss."""
    return X.distinct_class_count(_expr(spark, d).withColumn("intensity_cls", N.bin_intensity_4("intensity")))


@register("zscore_log1p", sql=f"WITH {SQL_EXPR} SELECT event_id, (ln(1 + intensity) - m) / s AS z FROM expr, "
          "(SELECT avg(ln(1 + intensity)) AS m, stddev_pop(ln(1 + intensity)) AS s FROM expr)")
def q_zscore_log1p(spark: SparkSession, d: str) -> DataFrame:
    """A4: (log1p(x) - mean) / population std over the whole table."""
    return finish(X.zscore_log1p(_expr(spark, d), "intensity").select("event_id", "z"))


@register("log1p_expm1", sql=f"WITH {SQL_EXPR} SELECT event_id, y, exp(y * {N.INTENSITY_LOG1P_STD!r} + "
          f"{N.INTENSITY_LOG1P_MEAN!r}) - 1 AS back FROM (SELECT event_id, (ln(1 + intensity) - {N.INTENSITY_LOG1P_MEAN!r})"
          f" / {N.INTENSITY_LOG1P_STD!r} AS y FROM expr)")
def q_log1p_expm1(spark: SparkSession, d: str) -> DataFrame:
    """forward standardisation and its inverse with the fixed constants."""
    e = _expr(spark, d).select("event_id", N.log1p_standardise("intensity").alias("y"))
    return finish(e.select("event_id", "y", N.expm1_destandardise("y").alias("back")))


@register("scan_by_dataset", sql=f"WITH {SQL_EXPR} SELECT * FROM expr WHERE dataset = 'click'")
def q_scan_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    """One data set out of a table holding several (filter reaches the scan)."""
    return finish(X.scan_by_dataset(_expr(spark, d), "click"))


# ------------------------------------------------------------- sequences
@register("upper_sequence", sql="SELECT doc_id AS row_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) "
          "AS sequence FROM documents")
def q_upper_sequence(spark: SparkSession, d: str) -> DataFrame:
    """F5 on the ASCII letters (stripped before upper-casing)."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("row_id"),
                       S.upper_sequence(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))


@register("strip_newlines", sql="SELECT doc_id AS row_id, replace(text, chr(10), '') AS text FROM documents")
def q_strip_newlines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"),
                                               S.strip_newlines("text").alias("text"))


_SQL_PAIRS = ("CASE WHEN length(sequence) >= 2 THEN list_transform(range(1, length(sequence)), "
              "lambda i: substr(sequence, i, 2)) ELSE [] END")


def _sql_energy_case(table_name: str, var: str) -> str:
    vals = S.DINUCLEOTIDE_TABLES[table_name]
    whens = " ".join(f"WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in vals.items())
    return f"CASE {var} {whens} END"


def _sql_energy(table_name: str) -> str:
    return (f"list_filter(list_transform({_SQL_PAIRS}, lambda p: {_sql_energy_case(table_name, 'p')}), "
            "lambda v: v IS NOT NULL)")


@register("dinucleotide_window", sql=f"WITH {B.SQL_DNA} SELECT row_id, {_SQL_PAIRS} AS pairs FROM dna")
def q_dinucleotide_window(spark: SparkSession, d: str) -> DataFrame:
    return B.dna_sequences(spark, d).select("row_id", S.dinucleotide_pairs("sequence").alias("pairs"))


@register("dinucleotide_energy", sql=f"WITH {B.SQL_LETTERS} SELECT row_id, {_sql_energy('CA_D')} AS ca_d, "
          f"{_sql_energy('AP_D')} AS ap_d FROM letters")
def q_dinucleotide_energy(spark: SparkSession, d: str) -> DataFrame:
    """F6 on letter strings: unknown pairs drop out and the row compacts left."""
    s = B.letter_sequences(spark, d)
    return finish(s.select("row_id", S.dinucleotide_energy("sequence", "CA_D").alias("ca_d"),
                           S.dinucleotide_energy("sequence", "AP_D").alias("ap_d")))


_SQL_PAD = ("list_concat(v, list_transform(range(greatest(400 - len(v), 0)), lambda x: CAST(0.0 AS DOUBLE)))")


@register("zero_pad", sql=f"WITH {B.SQL_LETTERS} SELECT row_id, {_SQL_PAD} AS features "
          f"FROM (SELECT row_id, {_sql_energy('CA_D')} AS v FROM letters)")
def q_zero_pad(spark: SparkSession, d: str) -> DataFrame:
    """right-pad to 400 (longer rows untouched)."""
    s = B.letter_sequences(spark, d)
    return finish(s.select("row_id", S.zero_pad(S.dinucleotide_energy("sequence", "CA_D")).alias("features")))


@register("feature_prefix", sql=f"WITH {B.SQL_LETTERS} SELECT row_id, ({_SQL_PAD})[1:400] AS features "
          f"FROM (SELECT row_id, {_sql_energy('CA_D')} AS v FROM letters)")
def q_feature_prefix(spark: SparkSession, d: str) -> DataFrame:
    """P4 after F7: exactly 400 features per row."""
    s = B.letter_sequences(spark, d)
    return finish(s.select("row_id", S.energy_features("sequence", "CA_D").alias("features")))


@register("dinucleotide_lookup", sql=f"WITH {B.SQL_LETTERS}, "
          f"pp AS (SELECT row_id, CAST(unnest(range(len(pairs))) AS INTEGER) AS pos, unnest(pairs) AS pair FROM "
          f"(SELECT row_id, {_SQL_PAIRS} AS pairs FROM letters)) "
          f"SELECT row_id, pos, pair, {_sql_energy_case('CA_D', 'pair')} AS value FROM pp "
          f"WHERE {_sql_energy_case('CA_D', 'pair')} IS NOT NULL")
def q_dinucleotide_lookup(spark: SparkSession, d: str) -> DataFrame:
    """J3 as a join: exploded pairs against the 16-row lookup table
    (a fixed-size table, so the broadcast is bounded)."""
    s = B.letter_sequences(spark, d)
    return finish(X.dinucleotide_lookup(s, "CA_D"))
