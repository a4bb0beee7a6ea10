"""Alignments as DataFrames: codon states, frequencies and site patterns.

A dataset's sequences are rows (dataset_id, taxon_idx, name, raw_seq). Everything here is columns and joins; no Python runs on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.functions.sequence import triplets
from clademill.model.codes import BASES, IUPAC, GeneticCode, code


def _base_mask(letter: Column) -> Column:
    """Bits of A, C, G, T that a letter may be: 15 for gaps and unknown letters."""
    out = F.lit(15)
    for c, options in IUPAC.items():
        out = F.when(letter == c, F.lit(sum(1 << BASES.index(b) for b in options))).otherwise(out)
    return out


def sites_long(sequences: DataFrame, name: str | int = "Universal") -> DataFrame:
    """(dataset_id, taxon_idx, name, site, triplet, state, mask): state -1 where a triplet is no single sense codon.

    Each distinct triplet is decoded once, and joined back: codes and ambiguity are a dimension of at most 17 ** 3 rows."""
    c: GeneticCode = code(name)
    long = sequences.select("dataset_id", "taxon_idx", "name", F.posexplode(triplets(F.replace(F.upper("raw_seq"), F.lit("U"), F.lit("T")))).alias("site", "triplet"))
    letters = "ACGT" + "".join(sorted(set(IUPAC) - set("ACGTU"))) + "-"
    rows = [(x + y + z, c.state.get(x + y + z, -1), c.mask(x + y + z)) for x in letters for y in letters for z in letters]
    table = F.broadcast(sequences.sparkSession.createDataFrame(rows, "triplet string, state int, mask long"))  # 15 ** 3 rows
    joined = long.join(table, "triplet", "left")
    return joined.select("dataset_id", "taxon_idx", "name", "site", "triplet", F.coalesce("state", F.lit(-1)).alias("state"), F.coalesce("mask", F.lit(c.everything)).alias("mask"))


def base_frequencies(sequences: DataFrame) -> DataFrame:
    """(dataset_id, scope, base, freq): resolved bases over all places and by codon position; zeros are padded with 1e-8."""
    long = sequences.select("dataset_id", F.posexplode(F.split(F.replace(F.upper("raw_seq"), F.lit("U"), F.lit("T")), "")).alias("pos", "base")).where(F.col("base").isin(*BASES))
    counts = long.groupBy("dataset_id", (F.col("pos") % 3 + 1).cast("string").alias("scope"), "base").agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = counts.unionByName(counts.groupBy("dataset_id", "base").agg(F.sum("n").alias("n")).withColumn("scope", F.lit("all")))
    every = counts.select("dataset_id", "scope").distinct().withColumn("base", F.explode(F.array(*map(F.lit, BASES))))
    share = Window.partitionBy("dataset_id", "scope")
    padded = every.join(counts, ["dataset_id", "scope", "base"], "left").withColumn("f", F.coalesce(F.col("n"), F.lit(0.0)) / F.sum(F.coalesce(F.col("n"), F.lit(0.0))).over(share))
    padded = padded.withColumn("f", F.greatest("f", F.lit(1e-8)))
    return padded.select("dataset_id", "scope", "base", (F.col("f") / F.sum("f").over(share)).alias("freq"))


def site_patterns(long: DataFrame) -> DataFrame:
    """(dataset_id, pattern_id, states, masks, weight, sites): distinct columns by states and masks, numbered in the order of their first sites."""
    columns = long.groupBy("dataset_id", "site").agg(F.array_sort(F.collect_list(F.struct("taxon_idx", "state", "mask"))).alias("c"))
    columns = columns.select("dataset_id", "site", F.col("c.state").alias("states"), F.col("c.mask").alias("masks"))
    grouped = columns.groupBy("dataset_id", "states", "masks").agg(F.count(F.lit(1)).cast("int").alias("weight"), F.sort_array(F.collect_list("site")).alias("sites"))
    number = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.col("sites")[0])) - 1
    return grouped.withColumn("pattern_id", number).select("dataset_id", "pattern_id", "states", "masks", "weight", "sites")


def invariant(states: str = "states") -> Column:
    return F.size(F.array_distinct(F.filter(states, lambda s: s >= 0))) <= 1


def composition(sequences: DataFrame) -> DataFrame:
    """(dataset_id, name, gc, gc3, n): GC content of each taxon, over all and third places."""
    long = sequences.select("dataset_id", "name", F.posexplode(F.split(F.upper("raw_seq"), "")).alias("pos", "base")).where(F.col("base").isin(*BASES))
    gc, third = F.col("base").isin("G", "C"), F.col("pos") % 3 == 2
    return long.groupBy("dataset_id", "name").agg((F.count_if(gc) / F.count(F.lit(1))).alias("gc"), (F.count_if(gc & third) / F.count_if(third)).alias("gc3"), F.count(F.lit(1)).alias("n"))


def slice_sites(sequences: DataFrame, start: int, end: int) -> DataFrame:
    """Nucleotides [start, end) of every sequence."""
    return sequences.withColumn("raw_seq", F.substring("raw_seq", start + 1, end - start))


def f1x4(pi: np.ndarray, c: GeneticCode) -> np.ndarray:
    out = np.array([pi[BASES.index(x)] * pi[BASES.index(y)] * pi[BASES.index(z)] for x, y, z in c.sense])
    return out / out.sum()


def cf3x4(observed: np.ndarray, c: GeneticCode) -> tuple[np.ndarray, np.ndarray]:
    """(position frequencies, codon frequencies): the position frequencies whose codon model, without stops, shows the observed ones."""
    index = np.array([[BASES.index(b) for b in x] for x in c.sense])
    p = observed.copy()
    for _ in range(200):
        pi = p[0, index[:, 0]] * p[1, index[:, 1]] * p[2, index[:, 2]]
        pi /= pi.sum()
        seen = np.array([np.bincount(index[:, k], pi, 4) for k in range(3)])
        new = p * observed / np.maximum(seen, 1e-12)
        new /= new.sum(axis=1, keepdims=True)
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-14:
            break
    pi = p[0, index[:, 0]] * p[1, index[:, 1]] * p[2, index[:, 2]]
    return p, pi / pi.sum()
