"""Text files: transforms, separated values, feature configurations."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators import scan
from strataline.operators.features import FITTED, KINDS, PARAMETERS, Computer

_NUMBER = r"([-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)"


def parse_transform(text: Column) -> Column:
    """struct<r, t> of `R 3x3`, nine numbers column by column, `t 3`, three numbers; null if anything is missing."""
    body = F.regexp_extract(text, r"(?s)R\s+3x3\s*\n(.*?)\n\s*t\s+3\s*\n", 1)
    tail = F.regexp_extract(text, r"(?s)\n\s*t\s+3\s*\n(.*)$", 1)
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(_NUMBER), 1), lambda v: F.regexp_replace(v, ",", ".").cast("double"))
    cols, t = numbers(body), numbers(tail)
    r = F.array(*(F.get(cols, F.lit(3 * j + i)) for i in range(3) for j in range(3)))
    return F.when((F.size(cols) == 9) & (F.size(t) == 3), F.struct(r.alias("r"), t.alias("t")))


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """path, r (row by row), t; files that are not whole transforms give null."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), parse_transform(F.col("value")).alias("x")).select("path", "x.r", "x.t")


def format_transform(r: Column, t: Column) -> Column:
    """The text that parse_transform reads."""
    cells = [F.get(r, F.lit(3 * i + j)).cast("string") for j in range(3) for i in range(3)]
    return F.concat(F.lit("R 3x3\n"), F.concat_ws(" ", *cells), F.lit("\nt 3\n"), F.array_join(F.transform(t, lambda v: v.cast("string")), " "), F.lit("\n"))


def write_transform(r: Sequence[float], t: Sequence[float], path: str) -> None:
    """One transform as a text file."""
    cells = " ".join(repr(float(r[3 * i + j])) for j in range(3) for i in range(3))
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"R 3x3\n{cells}\nt 3\n{' '.join(repr(float(v)) for v in t)}\n")


def point_lines(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """n, line: a header and a row for each point, `; ` between cells."""
    head = df.sparkSession.createDataFrame([(0, "; ".join(columns))], "n long, line string")
    return head.unionByName(_numbered(df, order, F.concat_ws("; ", *(F.col(c).cast("string") for c in columns))))


def cell_lines(df: DataFrame, columns: Sequence[str], order: Sequence[str], header: Sequence[str] | None = None) -> DataFrame:
    """n, line: every cell, the last too, followed by `; `."""
    line = F.concat(*(F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("; ")) for c in columns))
    rows = _numbered(df, order, line)
    return rows if header is None else df.sparkSession.createDataFrame([(0, "".join(f"{h}; " for h in header))], "n long, line string").unionByName(rows)


def _numbered(df: DataFrame, order: Sequence[str], line: Column) -> DataFrame:
    """Lines of a report, numbered from 1 in order."""
    keys = [f"sl_{i}" for i in range(len(order))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(order, keys)), line.alias("line"))
    return scan.numbered(rows, keys, out="n").select((F.col("n") + 1).alias("n"), "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file, in order of n; for reports."""
    lines.orderBy("n").coalesce(1).select("line").write.mode("overwrite").text(path)


def experiment_lines(results: DataFrame) -> DataFrame:
    return cell_lines(results, ["macro", "test", "relative_distance"], ["macro", "test"], ["macro", "test", "relativeDistance"])


CONFIG = "struct<configurations:array<struct<FeatureComputerType:int,Parameters:map<string,struct<Value:string>>>>>"


def parse_config(text: Column) -> Column:
    """configurations as rows would have them: type number and a map of parameter values, as text."""
    return F.from_json(text, CONFIG)["configurations"]


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """path, n, type, kind, parameters: a row for each computer of each file; a file that is no JSON gives none."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(parse_config(F.col("value"))).alias("n", "c"))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    kind = F.col("c.FeatureComputerType")
    return text.select("path", "n", kind.alias("type"), F.when(kind >= 0, F.get(kinds, kind)).alias("kind"), F.transform_values("c.Parameters", lambda _, v: v["Value"]).alias("parameters"))


def config_text(computers: Sequence[Computer], border: float = 0.15, radius: int = 0) -> str:
    """JSON that `features.computers_from_json` reads; border and radius are written for fitted computers without their own."""
    rows = []
    for c in computers:
        own = {"border": border, "radius": radius} | c.params if c.kind in FITTED else c.params
        values = {name: own[k] for k, (name, _) in PARAMETERS.get(c.kind, {}).items()}
        rows.append({"FeatureComputerType": KINDS.index(c.kind), "Parameters": {k: {"Value": list(v) if isinstance(v, tuple) else v} for k, v in values.items()}})
    return json.dumps({"configurations": rows}, indent=2)
