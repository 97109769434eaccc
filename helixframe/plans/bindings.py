"""How the operators' inputs are derived from the driver tables.

Each binding exists twice: as a Spark plan (used by the queries) and as a
DuckDB CTE (used by the oracle SQL).  Both read whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequence import ascii_letters, dna_letters
from helixframe.sources.tables import table

# --- fixed values of the bindings ---
MARKER = "TTAGT"          # marker for the prefix cut (present in ~40% of rows)
SEED_K = 11               # k-mer length of the seed join
NAN = float("nan")
# --- end of fixed values ---


# ---------------------------------------------------------------- sequences
def dna_sequences(spark: SparkSession, d: str) -> DataFrame:
    """row_id = doc_id, sequence = the A/C/G/T letters of the whole text."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"), dna_letters("text").alias("sequence"))


SQL_DNA = ("dna AS (SELECT doc_id AS row_id, "
           "upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS sequence FROM documents)")


def letter_sequences(spark: SparkSession, d: str) -> DataFrame:
    """All ASCII letters, upper-cased: unknown dinucleotides occur."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"), ascii_letters("text").alias("sequence"))


SQL_LETTERS = ("letters AS (SELECT doc_id AS row_id, "
               "upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents)")


def subject_sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("subject_id"), dna_letters("text").alias("sequence"))


SQL_SUBJECTS = ("subj AS (SELECT CAST(item_id AS VARCHAR) AS subject_id, "
                "upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS sequence FROM benchmark)")


# ------------------------------------------------------------ score tables
def score_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    """Candidate sequences plus three score tables keyed by row_id.

    authenticity: a logit with NaN rows; cls2: a logit with many ties;
    cls4: a class 0..3 known only for labelled documents (outer-join nulls).
    """
    docs = table(spark, d, "documents")
    seqs = docs.select(F.col("doc_id").alias("row_id"), dna_letters("text").alias("sequence"))
    auth = docs.select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("n_chars") % 13 == 0, F.lit(NAN))
        .otherwise((F.col("doc_id") * 37 % 101).cast("double") / 10.0 - 5.0).alias("authenticity_cls"))
    cls2 = docs.select(F.col("doc_id").alias("row_id"),
                       ((F.col("n_chars") % 7).cast("double") / 2.0 - 1.5).alias("transcript_level_cls2"))
    cls4 = table(spark, d, "labels").select(
        F.col("doc_id").alias("row_id"),
        (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("transcript_level_cls4"))
    return [seqs, auth, cls2, cls4]


SQL_SCORES = """
seqs AS (SELECT doc_id AS row_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS sequence FROM documents),
auth AS (SELECT doc_id AS row_id,
                CASE WHEN n_chars % 13 = 0 THEN CAST('NaN' AS DOUBLE)
                     ELSE CAST((doc_id * 37) % 101 AS DOUBLE) / 10.0 - 5.0 END AS authenticity_cls
         FROM documents),
cls2 AS (SELECT doc_id AS row_id, CAST(n_chars % 7 AS DOUBLE) / 2.0 - 1.5 AS transcript_level_cls2 FROM documents),
cls4 AS (SELECT doc_id AS row_id, CAST(quality * 2 + toxic AS INTEGER) AS transcript_level_cls4 FROM labels),
zipped AS (
  SELECT COALESCE(seqs.row_id, auth.row_id, cls2.row_id, cls4.row_id) AS row_id,
         seqs.sequence, auth.authenticity_cls, cls2.transcript_level_cls2, cls4.transcript_level_cls4
  FROM seqs
  FULL OUTER JOIN auth ON auth.row_id = seqs.row_id
  FULL OUTER JOIN cls2 ON cls2.row_id = COALESCE(seqs.row_id, auth.row_id)
  FULL OUTER JOIN cls4 ON cls4.row_id = COALESCE(seqs.row_id, auth.row_id, cls2.row_id))
"""

SQL_RANKED = """
ranked AS (
  SELECT *, row_number() OVER (ORDER BY
      CASE WHEN isnan(authenticity_cls) THEN NULL ELSE authenticity_cls END DESC NULLS LAST,
      CASE WHEN isnan(transcript_level_cls2) THEN NULL ELSE transcript_level_cls2 END DESC NULLS LAST,
      transcript_level_cls4 DESC NULLS LAST, row_id ASC) AS sort_pos
  FROM zipped)
"""


def sql_cut(src: str, marker: str = MARKER) -> str:
    return f"""
cut AS (
  SELECT * REPLACE (
           CASE WHEN instr(sequence, '{marker}') > 0 THEN substr(sequence, 1, instr(sequence, '{marker}') - 1)
                ELSE substr(sequence, 1, greatest(length(sequence) - 1, 0)) END AS sequence),
         instr(sequence, '{marker}') > 0 AS marker_found
  FROM {src})
"""


def sql_seed_hits(queries: str, subjects: str, k: int = SEED_K, link: int | None = None,
                  max_evalue: float = 10.0) -> str:
    """CTE chain ending in ``hits`` (12 columns): seeds position by position,
    and the best part of a chain letter by letter from prefix sums."""
    link = 2 * k if link is None else link
    return f"""
qo AS (
  SELECT query_id, length(q_seq) AS q_len, '+' AS strand, q_seq AS oriented FROM {queries}
  UNION ALL
  SELECT query_id, length(q_seq), '-', translate(reverse(q_seq), 'ACGT', 'TGCA') FROM {queries}),
qk AS (
  SELECT query_id, strand, q_pos, substr(oriented, q_pos + 1, {k}) AS kmer
  FROM (SELECT query_id, strand, oriented,
               unnest(range(0, greatest(length(oriented) - {k} + 1, 0))) AS q_pos FROM qo)),
sk AS (
  SELECT subject_id, s_pos, substr(s_seq, s_pos + 1, {k}) AS kmer
  FROM (SELECT subject_id, s_seq, unnest(range(0, greatest(length(s_seq) - {k} + 1, 0))) AS s_pos
        FROM {subjects})),
seeds AS (
  SELECT qk.query_id, sk.subject_id, qk.strand, qk.q_pos, sk.s_pos - qk.q_pos AS diag
  FROM qk JOIN sk ON qk.kmer = sk.kmer),
chained AS (
  SELECT *, SUM(CASE WHEN q_pos - prev > {link} THEN 1 ELSE 0 END)
              OVER (PARTITION BY query_id, subject_id, strand, diag ORDER BY q_pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain
  FROM (SELECT *, lag(q_pos) OVER (PARTITION BY query_id, subject_id, strand, diag ORDER BY q_pos) AS prev
        FROM seeds)),
segs AS (
  SELECT query_id, subject_id, strand, diag, chain, MIN(q_pos) AS qs0, MAX(q_pos) + {k} AS qe0
  FROM chained GROUP BY ALL),
chain_letters AS (
  SELECT query_id, subject_id, strand, diag, chain, q_len, i,
         CASE WHEN substr(oriented, i + 1, 1) = substr(s_seq, i + diag + 1, 1) THEN 1 ELSE -2 END AS v
  FROM (SELECT segs.*, qo.q_len, qo.oriented, s.s_seq, unnest(range(qs0, qe0)) AS i
        FROM segs JOIN qo USING (query_id, strand) JOIN {subjects} s USING (subject_id))),
prefix AS (
  SELECT *, SUM(v) OVER (PARTITION BY query_id, subject_id, strand, diag, chain ORDER BY i
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM chain_letters),
lowest AS (
  SELECT *, MIN(p - v) OVER (PARTITION BY query_id, subject_id, strand, diag, chain ORDER BY i
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM prefix),
tops AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, subject_id, strand, diag, chain
                                              ORDER BY p - low DESC, i ASC) AS rn FROM lowest) WHERE rn = 1),
parts AS (
  SELECT query_id, subject_id, strand, diag, chain, any_value(t.q_len) AS q_len, MIN(l.i) AS qs0, any_value(t.i) + 1 AS qe0
  FROM tops t JOIN lowest l USING (query_id, subject_id, strand, diag, chain)
  WHERE l.i <= t.i AND l.p - l.v = t.low GROUP BY ALL),
scored AS (
  SELECT query_id, subject_id, strand, diag, chain, parts.q_len, qs0, qe0, CAST(qe0 - qs0 AS INTEGER) AS align_len,
         CAST(count(*) FILTER (WHERE v = 1) AS INTEGER) AS ident,
         (SELECT SUM(length(s_seq)) FROM {subjects}) AS db_len
  FROM parts JOIN chain_letters c USING (query_id, subject_id, strand, diag, chain)
  WHERE c.i >= qs0 AND c.i < qe0 GROUP BY ALL),
scored2 AS (
  SELECT *, CAST(align_len - ident AS INTEGER) AS mismatches,
         (CAST(1.28 AS DOUBLE) * (ident * 1 + (align_len - ident) * -2) - ln(CAST(0.46 AS DOUBLE))) / ln(CAST(2.0 AS DOUBLE)) AS bit_score
  FROM scored),
hits AS (
  SELECT query_id, subject_id,
         round(CAST(100.0 AS DOUBLE) * ident / align_len, 3) AS pct_identity,
         align_len, mismatches, 0 AS gap_opens,
         CAST(CASE WHEN strand = '+' THEN qs0 + 1 ELSE q_len - qe0 + 1 END AS INTEGER) AS q_start,
         CAST(CASE WHEN strand = '+' THEN qe0 ELSE q_len - qs0 END AS INTEGER) AS q_end,
         CAST(CASE WHEN strand = '+' THEN qs0 + diag + 1 ELSE qe0 + diag END AS INTEGER) AS s_start,
         CAST(CASE WHEN strand = '+' THEN qe0 + diag ELSE qs0 + diag + 1 END AS INTEGER) AS s_end,
         CAST(q_len AS DOUBLE) * CAST(db_len AS DOUBLE) * pow(2.0, -bit_score) AS e_value,
         bit_score
  FROM scored2
  WHERE CAST(q_len AS DOUBLE) * CAST(db_len AS DOUBLE) * pow(2.0, -bit_score) <= {max_evalue})
"""


SQL_BEST_HIT = """
best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
                                 ORDER BY bit_score DESC, e_value ASC, subject_id ASC, s_start ASC,
                                          q_start ASC, s_end ASC, q_end ASC) AS rn
    FROM hits) WHERE rn = 1)
"""
