"""Further outputs: sequence graphs, codon and preference tables, partitions, text tables, bundles and dossiers."""

from __future__ import annotations

import contextlib
import html
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gfa_lines(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(value): a sequence graph from (id, seq) and (from_id, to_id, weight) as GFA 1: a header, segments, links with their counts."""
    head = segments.sparkSession.createDataFrame([(0, "H\tVN:Z:1.0")], "part int, value string")
    s = segments.select(F.lit(1).alias("part"), F.concat_ws("\t", F.lit("S"), F.col("id").cast("string"), "seq").alias("value"))
    ends = [F.lit("L"), F.col("from_id").cast("string"), F.lit("+"), F.col("to_id").cast("string"), F.lit("+"), F.lit("0M"), F.concat(F.lit("RC:i:"), F.col("weight").cast("long"))]
    return head.unionByName(s).unionByName(links.select(F.lit(2).alias("part"), F.concat_ws("\t", *ends).alias("value"))).orderBy("part", "value").select("value")


def dot_lines(segments: DataFrame, links: DataFrame, name: str = "graph") -> DataFrame:
    """(value): the same graph as DOT."""
    label = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    ends = segments.sparkSession.createDataFrame([(0, f"digraph {name} {{"), (3, "}")], "part int, value string")
    s = segments.select(F.lit(1).alias("part"), F.concat(F.lit("  "), label(F.col("id")), F.lit(" [label="), label(F.col("seq")), F.lit("];")).alias("value"))
    edges = links.select(F.lit(2).alias("part"), F.concat(F.lit("  "), label(F.col("from_id")), F.lit(" -> "), label(F.col("to_id")), F.lit(" [weight="), F.col("weight").cast("long"), F.lit("];")).alias("value"))
    return ends.unionByName(s).unionByName(edges).orderBy("part", "value").select("value")


def wide_preferences(preferences: DataFrame) -> DataFrame:
    """(site, A, C, .. Y): preferences from rows of (site, aa, value), a column for each amino acid, to be written as a table."""
    return preferences.groupBy("site").pivot("aa", list("ACDEFGHIKLMNPQRSTVWY")).agg(F.first("value")).orderBy("site")


def codon_rows(wide: DataFrame, site: str = "site") -> DataFrame:
    """A column for each codon -> (site, codon, value), without nulls."""
    others = [c for c in wide.columns if c != site]
    return wide.unpivot([site], others, "codon", "value").where("value is not null")


def partition_lines(partition: DataFrame) -> DataFrame:
    """(value): synonymous classes as a table that sources.tables.parse_partition reads again."""
    third = F.coalesce(F.col("rate").cast("string"), F.col("class"))
    head = partition.sparkSession.createDataFrame([(0, "codon1\tcodon2\tclass")], "part int, value string")
    return head.unionByName(partition.select(F.lit(1).alias("part"), F.concat_ws("\t", "codon1", "codon2", third).alias("value"))).orderBy("part", "value").select("value")


def text_table(df: DataFrame, rows: int = 20, width: int = 24) -> str:
    """The first rows as a table for a terminal; what is left out is said."""
    found = df.limit(rows + 1).collect()
    cells = [df.columns, *[["-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in found[:rows]]]
    cells = [[c if len(c) <= width else c[: width - 1] + "…" for c in r] for r in cells]
    size = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    lines = ["  ".join(c.ljust(s) for c, s in zip(r, size, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * s for s in size), *lines[1:], *(["…"] if len(found) > rows else [])])


def write_whole(path: str, text: str) -> None:
    """A local file that is there as a whole or not at all; DataFrames have Spark's committer for that."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, part = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        os.replace(part, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.remove(part)
        raise


def write_bundle(documents: dict[str, str], folder: str) -> list[str]:
    """One JSON document for each analysis of a run, and an index of them; gives the paths."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for name, text in sorted(documents.items()):
        json.loads(text)
        out.append(f"{folder}/{name}.json")
        write_whole(out[-1], text)
    write_whole(f"{folder}/index.json", json.dumps({"documents": [os.path.basename(p) for p in out]}, indent=1))
    return [*out, f"{folder}/index.json"]


def dossier(title: str, sections: dict[str, DataFrame], rows: int = 50) -> str:
    """A page with a table for each section, the first `rows` rows of each; text is escaped."""
    cell = lambda v: html.escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
    parts = []
    for name, df in sections.items():
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        parts.append(f"<section><h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>{body}</table></section>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"
