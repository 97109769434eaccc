"""Column functions on nucleotide strings (all JVM-side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: dinucleotide lookup tables (must equal the published ones) ---
# CA_D: positive pair values; AP_D: negative pair values.
DINUCLEOTIDE_TABLES: dict[str, dict[str, float]] = {
    "CA_D": {
        "AA": 0.703, "AT": 0.854, "TA": 0.615, "AG": 0.78,
        "GA": 1.23, "TT": 0.703, "AC": 1.323, "CA": 0.79,
        "TG": 0.79, "GT": 1.323, "TC": 1.23, "CT": 0.78,
        "CC": 0.984, "CG": 1.124, "GC": 1.792, "GG": 0.984,
    },
    "AP_D": {
        "AA": -17.5, "AT": -16.7, "TA": -17.0, "AG": -15.8,
        "GA": -14.7, "TT": -17.5, "AC": -18.1, "CA": -19.5,
        "TG": -19.5, "GT": -18.1, "TC": -14.7, "CT": -15.8,
        "CC": -14.9, "CG": -19.2, "GC": -14.7, "GG": -14.9,
    },
}
# Feature width used by the classic models (pairs kept after padding).
FEATURE_WIDTH = 400
# --- end of fixed values ---


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dna_letters(text: Column | str) -> Column:
    """Keep only A/C/G/T (either case) and upper-case them."""
    return F.upper(F.regexp_replace(_c(text), "[^ACGTacgt]", ""))


def ascii_letters(text: Column | str) -> Column:
    """Keep ASCII letters only, then upper-case (strip before ``upper``)."""
    return F.upper(F.regexp_replace(_c(text), "[^A-Za-z]", ""))


def upper_sequence(seq: Column | str) -> Column:
    """F5."""
    return F.upper(_c(seq))


def strip_newlines(seq: Column | str) -> Column:
    """remove embedded newlines."""
    return F.regexp_replace(_c(seq), "\n", "")


def concat_promoter_gene(promoters: Column | str, genes: Column | str) -> Column:
    """Null in either part gives null (same as NaN + str in pandas)."""
    return F.concat(_c(promoters), _c(genes))


def cut_at_marker(seq: Column | str, marker: str, on_missing: str = "drop_last") -> Column:
    """prefix before the first ``marker``.

    ``on_missing="drop_last"`` reproduces the parity behaviour (a missing
    marker loses the final letter); ``"keep"`` keeps the whole sequence.
    """
    s = _c(seq)
    pos = F.instr(s, marker)
    if on_missing == "drop_last":
        missing = F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0)))
    elif on_missing == "keep":
        missing = s
    else:
        raise ValueError(on_missing)
    return F.when(pos > 0, F.substring(s, F.lit(1), pos - 1)).otherwise(missing)


def marker_found(seq: Column | str, marker: str) -> Column:
    return F.instr(_c(seq), marker) > 0


def dinucleotide_pairs(seq: Column | str) -> Column:
    """Width-2 windows, step 1, of the upper-cased sequence.

    One linear regex pass with a look-ahead group: ``substring`` at every
    position would rescan the UTF-8 string from its start each time
    (quadratic per row).  Strings shorter than 2 give an empty array.
    """
    return windows(F.upper(_c(seq)), 2)


def windows(seq: Column | str, k: int) -> Column:
    """All overlapping length-k windows, in order, as ``array<string>``."""
    return F.regexp_extract_all(_c(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), 1)


def _table_map(table: str) -> Column:
    values = DINUCLEOTIDE_TABLES[table]
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])


def dinucleotide_energy(seq: Column | str, table: str = "CA_D", keep_position: bool = False) -> Column:
    """F6 = W6 + J3: pair values; unknown pairs removed (row compacts left).

    With ``keep_position=True`` unknown pairs become 0.0 instead.
    """
    m = _table_map(table)
    looked = F.transform(dinucleotide_pairs(seq), lambda p: F.try_element_at(m, p))
    if keep_position:
        return F.transform(looked, lambda v: F.coalesce(v, F.lit(0.0)))
    return F.filter(looked, lambda v: v.isNotNull())


def zero_pad(values: Column | str, width: int = FEATURE_WIDTH) -> Column:
    """right-pad with 0.0 to ``width`` (longer rows are left as they are)."""
    v = _c(values)
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(v), F.lit(0))))


def feature_prefix(values: Column | str, width: int = FEATURE_WIDTH) -> Column:
    """The first ``width`` positions."""
    return F.slice(_c(values), 1, width)


def energy_features(seq: Column | str, table: str = "CA_D", width: int = FEATURE_WIDTH) -> Column:
    """F6 -> F7 -> P4: a fixed-width feature array."""
    return feature_prefix(zero_pad(dinucleotide_energy(seq, table), width), width)


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(_c(seq)), "ACGT", "TGCA")


def kmers(seq: Column | str, k: int) -> Column:
    """All overlapping k-mers, in order (index = 0-based start position)."""
    return windows(seq, k)
