"""Sinks: FASTA, Newick, Stockholm, TSV, CSV and JSON documents, and an HTML report."""

from __future__ import annotations

import html
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.functions.sequence import csv_field
from clademill.functions.stats import clean


def fasta_lines(sequences: DataFrame) -> DataFrame:
    return sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), "raw_seq").alias("value"))


def write_fasta(sequences: DataFrame, path: str) -> None:
    fasta_lines(sequences).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def csv_rows(df: DataFrame) -> DataFrame:
    """The rows of a filtered and sorted view as CSV text."""
    return df.select(F.concat_ws(",", *(csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns)).alias("value"))


def stockholm(sequences: DataFrame, posterior: str | None = None) -> DataFrame:
    """(dataset_id, value): one Stockholm text for each dataset; rows in the order of the taxa."""
    rows = sequences.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("taxon_idx", F.concat_ws(" ", "name", "raw_seq").alias("line")))).alias("l"))
    tail = F.lit(f"#=GC PP_cons {posterior}\n//" if posterior else "//")
    return rows.select("dataset_id", F.concat(F.lit("# STOCKHOLM 1.0\n"), F.array_join(F.col("l.line"), "\n"), F.lit("\n"), tail).alias("value"))


def columnar(df: DataFrame, order: list[str]) -> DataFrame:
    """One row, one array for each column, all of the same length; numbers that aren't finite become null."""
    numbers = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    rows = df.select(*(clean(F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in rows.columns if c not in order)))).alias("r"))
    return listed.select(*(F.col("r")[c].alias(c) for c in df.columns))


def document(df: DataFrame, method: str, order: list[str], facts: dict | None = None) -> str:
    """A results document: envelope, provenance and the columns of the table."""
    columns = json.loads(columnar(df, order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    kinds = {f.name: {"double": "number", "float": "number", "int": "integer", "long": "integer", "string": "string", "boolean": "boolean"}.get(f.dataType.typeName(), "object") for f in df.schema}
    kinds = {k: "integer" if v == "object" and df.schema[k].dataType.typeName() in ("integer", "bigint") else v for k, v in kinds.items()}
    envelope = {
        "analysis": {"method": method},
        "software": {"name": "clademill"},
        "provenance": {"created": datetime.now(UTC).isoformat(timespec="seconds")},
        "dataset": facts or {},
        "site_results": {"rows": df.count(), "columns": [{"name": c, "type": kinds[c], "values": columns.get(c)} for c in df.columns]},
    }
    return json.dumps(envelope, ensure_ascii=False)


def legacy_document(df: DataFrame, order: list[str]) -> str:
    """Headers with descriptions, and rows of values."""
    rows = [list(r) for r in df.orderBy(*order).collect()]
    return json.dumps({"MLE": {"headers": [[c, c.replace("_", " ")] for c in df.columns], "content": {"0": rows}}}, default=str)


def script_safe(text: str) -> str:
    """JSON that may stand inside a script element."""
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def report(title: str, body: str) -> str:
    """A page with the document inside and a plain table of its columns."""
    found = json.loads(body)
    table = found.get("site_results", {}).get("columns", [])
    head = "".join(f"<th>{html.escape(c['name'])}</th>" for c in table)
    rows = zip(*(c["values"] or [] for c in table), strict=False)
    cells = "\n".join("<tr>" + "".join(f"<td>{html.escape(f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>\n{cells}</table><script type='application/json'>{script_safe(body)}</script></body></html>"
