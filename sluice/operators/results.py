"""The document of all results: every figure with its section, name and field, and the same as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import write_json


def long_form(
    section: str, rows: DataFrame, name: str, numbers: tuple[str, ...] = (), texts: tuple[str, ...] = ()
) -> DataFrame:
    """``(section, name, field, number, text)`` of a table of results; ``name`` is an expression over its columns."""
    none, empty = F.lit(None).cast("double"), F.lit(None).cast("string")
    cell = lambda c, number, text: F.struct(F.lit(c).alias("field"), number.alias("number"), text.alias("text"))
    cells = [
        cell(c, F.col(c).cast("double"), empty) for c in numbers
    ] + [cell(c, none, F.col(c).cast("string")) for c in texts]
    return rows.select(
        F.lit(section).alias("section"), F.expr(name).alias("name"), F.explode(F.array(*cells)).alias("c")
    ).select("section", "name", "c.*")


def long_sql(section: str, rows: str, name: str, numbers: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> str:
    """The same in SQL over the statement ``rows``."""
    cells = [
        (c, f"{c}::DOUBLE", "NULL::VARCHAR") for c in numbers
    ] + [(c, "NULL::DOUBLE", f"{c}::VARCHAR") for c in texts]
    parts = [f"SELECT '{section}' AS section, {name} AS name, '{c}' AS field, {number} AS number, {text} AS text FROM t" for c, number, text in cells]
    return f"SELECT * FROM (WITH t AS ({rows}) {' UNION ALL '.join(parts)})"


def nested(cells: DataFrame) -> dict:
    """Sections, names and fields as a document. The results of a fixed set of runs are few, whatever the rows behind them."""
    out: dict = {}
    for r in cells.collect():
        value = r["text"] if r["number"] is None else r["number"]
        out.setdefault(r["section"], {}).setdefault(r["name"], {})[r["field"]] = value
    return out


def write_results(spark: SparkSession, path: str, cells: DataFrame, run_name: str, note: str = "") -> dict:
    """Write the document with its name and note and whether all gates passed."""
    body = nested(cells)
    passed = [g.get("passed") == "true" for g in body.get("gates", {}).values()]
    document = {"run_name": run_name, "note": note, "all_gates_passed": bool(passed) and all(passed), **body}
    write_json(spark, path, document)
    return document
