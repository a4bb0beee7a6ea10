"""Sequences and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clademill.model.codes import CODONS, code


def reverse_complement(seq: Column) -> Column:
    """The other strand; letters other than A, C, G, T, U become N."""
    return F.reverse(F.translate(F.regexp_replace(F.translate(seq, "acgtu", "ACGTU"), "[^ACGTU]", "N"), "ACGTU", "TGCAA"))


def triplets(seq: Column, frame: int = 0) -> Column:
    """Whole triplets from an offset, as an array."""
    n = F.floor((F.length(seq) - frame) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(seq, k * 3 + 1 + frame, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def amino_map(name: str | int = "Universal") -> Column:
    c = code(name)
    return F.create_map(*(F.lit(x) for pair in zip(CODONS, c.amino, strict=True) for x in pair))


def translate_dna(seq: Column, frame: int = 0, name: str | int = "Universal") -> Column:
    """Amino acids of a sequence of A, C, G, T; X for any other triplet."""
    lookup = amino_map(name)
    return F.array_join(F.transform(triplets(seq, frame), lambda t: F.coalesce(lookup[t], F.lit("X"))), "")


def species_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), "[^A-Za-z0-9]+", "_")


def scrub(message: Column) -> Column:
    """Error text without paths and addresses, on one line."""
    out = F.regexp_replace(message, r"(/[A-Za-z0-9._-]+)+", "<path>")
    out = F.regexp_replace(out, r"\b\d{1,3}(\.\d{1,3}){3}\b", "<addr>")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def csv_field(text: Column) -> Column:
    """Quoted where it has a quote, comma or line break."""
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def format_p(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), F.lit("-")).when(p < 0.001, F.lit("<0.001")).otherwise(F.format_string("%.3f", p))


def format_omega(omega: Column) -> Column:
    return F.when(omega.isNull(), F.lit("-")).when(omega >= 1e4, F.lit("∞")).otherwise(F.format_string("%.2f", omega))


def format_factor(bf: Column) -> Column:
    return F.when(bf.isNull(), F.lit("-")).when(bf >= 1e4, F.lit("≥10,000")).otherwise(F.format_string("%.1f", bf))
