"""Column expressions on sequences: complement, trimming, quality, identifiers, rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IUPAC letters and their complements (fixed values).
IUPAC, COMPLEMENT = "ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"
#: Residues of aligned sequences (fixed values).
ALPHABETS = {"dna": "ACGT-", "protein": "ACDEFGHIKLMNPQRSTVWY-"}


def reverse_complement(seq: Column) -> Column:
    """Reverse complement, both cases and IUPAC codes; other characters stay."""
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def rint_to(x: Column, digits: int) -> Column:
    """Round half to even at ``digits`` decimals by scaling, as numpy does."""
    return F.rint(x * float(10**digits)) / float(10**digits)


def strip_cr(seq: Column) -> Column:
    """Without carriage returns."""
    return F.replace(seq, F.lit("\r"), F.lit(""))


def u_to_t(seq: Column) -> Column:
    """RNA letters as DNA."""
    return F.translate(seq, "U", "T")


def only_alphabet(seq: Column, kind: str) -> Column:
    """True if every character is in the alphabet ``kind`` (dna or protein, upper case and gaps)."""
    if kind not in ALPHABETS:
        raise ValueError(f"unknown sequence type {kind!r}")
    return ~seq.rlike(f"[^{ALPHABETS[kind]}]")


def mean_error(quality: Column) -> Column:
    """Mean of 10^(-Q/10) over a Phred+33 string; null for an empty one."""
    errors = F.transform(F.split(quality, ""), lambda c: F.pow(F.lit(10.0), -(F.ascii(c) - 33) / 10.0))
    return F.when(F.length(quality) > 0, F.aggregate(errors, F.lit(0.0), lambda a, e: a + e) / F.length(quality))


def compose_id(*names: str) -> Column:
    """``Rank=1;Reads=20;RPU=300`` from the columns named."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])


def to_number(x: Column) -> Column:
    """A DOUBLE, or null where the text is no finite number."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Unit-cost edit distance; with ``most``, -1 beyond it (found early)."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def contains_text(x: Column, text: str) -> Column:
    """Case-insensitive substring test; null counts as no match."""
    return F.coalesce(F.lower(x.cast("string")).contains(text.lower()), F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
