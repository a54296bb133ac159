"""Published reports: tables as JSON and Markdown and tuned thresholds as YAML, each set whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.config import Settings
from terrashift.sources import storage


def cell(value: Column, kind: str) -> Column:
    """A value as a table shows it: lists joined by commas, nothing as ``not assessed``."""
    text = F.array_join(value.cast("array<string>"), ", ") if kind.startswith("array") else value.cast("string")
    return F.coalesce(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("not assessed"))


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """The rows as lines (line, value) of a Markdown table under a title; made by the executors, a line a row."""
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    top = rows.sparkSession.createDataFrame([(k, v) for k, v in enumerate(head)], "line bigint, value string").coalesce(1)
    cells = [cell(F.col(c), kind) for c, kind in rows.dtypes]
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select((F.monotonically_increasing_id() + len(head)).alias("line"), text.alias("value"))
    return top.unionByName(body)


def publish(path: str, tables: dict[str, DataFrame], title: str, settings: Settings | None = None, note: dict | None = None) -> str:
    """Each table as JSON lines and as Markdown in one new version of ``path``; the marker has the configuration's fingerprint.

    The tables of a report are results (tuning, funnel, calibration, operating
    points), not the rows behind them, so each is one file in its own order.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = {}
    for name, rows in tables.items():
        held = storage.written(rows.coalesce(1), "report").coalesce(1)
        parts[name] = lambda folder, held=held: held.write.json(folder)
        lines = markdown(held, f"{title}: {name}").coalesce(1).sortWithinPartitions("line").select("value")
        parts[f"{name}-report"] = lambda folder, lines=lines: lines.write.text(folder)
    return storage.publish(spark, path, parts, {"config_sha": (settings or Settings()).sha()} | (note or {}))


def tuned_yaml(best: DataFrame, names: list[str], split: str) -> DataFrame:
    """The thresholds of the row ``best`` as lines of YAML that ``config.from_yaml`` reads, in order of name."""
    lines = [F.lit(f"# In-sample fit on split {split}"), F.lit("gate:")]
    lines += [F.concat(F.lit(f"  {n}: "), F.col(n).cast("string")) for n in sorted(names)]
    return best.select(F.posexplode(F.array(*lines)).alias("line", "value"))


def publish_tuning(best: DataFrame, path: str, names: list[str], split: str) -> str:
    """best and baseline as a table, and the best thresholds as YAML."""
    held = storage.written(best, "tuning")
    spark = best.sparkSession
    yaml = tuned_yaml(held.where("which = 'best'"), names, split).coalesce(1).sortWithinPartitions("line").select("value")
    lines = markdown(held, f"Tuning on {split}, in-sample").coalesce(1).sortWithinPartitions("line").select("value")
    parts = {"result": lambda folder: held.coalesce(1).write.json(folder), "report": lambda folder: lines.write.text(folder), "thresholds": lambda folder: yaml.write.text(folder)}
    return storage.publish(spark, path, parts, {"split": split})
