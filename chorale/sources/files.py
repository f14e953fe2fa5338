"""Flat files: JSONL, CSV with a byte-order mark, JSON results, YAML-like configuration, and their writers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UTTERANCES = (
    "utterance_id string, scenario_uid string, policy_id string, model_id string, pass_name string, direction string, phase string, round string, turn_index int, "
    "persona_name string, stakeholder_type string, kg_role string, flag_policyrole boolean, mislabel_source string, deontic_status string, text string, evidence array<string>, "
    "judgment string, prediction_values string"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = UTTERANCES) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Strings only; a byte-order mark, quoted newlines and doubled quotes are understood."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The listed columns, absent ones and nulls empty, lists joined with "; ". The path must be new."""
    out = []
    for c in columns or df.columns:
        if c not in df.columns:
            out.append(F.lit("").alias(c))
        elif dict(df.dtypes)[c].startswith("array"):
            out.append(F.coalesce(F.array_join(c, "; "), F.lit("")).alias(c))
        else:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
    df.select(*out).write.mode("error").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_results(df: DataFrame, path: str, keys: list[str]) -> None:
    """One JSON object a set: the key columns joined as `set`, everything else nested under `result`."""
    rest = [c for c in df.columns if c not in keys]
    df.select(F.concat_ws("_", *keys).alias("set"), F.struct(*rest).alias("result")).coalesce(1).write.mode("error").json(path)


def parse_config(text: str) -> dict[str, Any]:
    """The subset of YAML that such configurations use: nested maps, lists, flow lists and maps, quoted or plain scalars."""
    lines = [line for raw in text.splitlines() if (line := _uncomment(raw).rstrip())]
    value, rest = _block(lines, 0)
    if rest < len(lines):
        raise ValueError(f"cannot read line: {lines[rest]!r}")
    return value


def _uncomment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _block(lines: list[str], at: int) -> tuple[Any, int]:
    indent = _indent(lines[at])
    if lines[at].lstrip().startswith("- "):
        items = []
        while at < len(lines) and _indent(lines[at]) == indent and lines[at].lstrip().startswith("- "):
            items.append(_scalar(lines[at].lstrip()[2:].strip()))
            at += 1
        return items, at
    out = {}
    while at < len(lines) and _indent(lines[at]) == indent:
        key, _, rest = lines[at].strip().partition(":")
        at += 1
        if rest.strip():
            out[_scalar(key.strip())] = _scalar(rest.strip())
        elif at < len(lines) and (_indent(lines[at]) > indent or lines[at].lstrip().startswith("- ")):
            out[_scalar(key.strip())], at = _block(lines, at)
        else:
            out[_scalar(key.strip())] = None
    return out, at


def _split(text: str) -> list[str]:
    parts, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def _scalar(text: str) -> Any:
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(p) for p in _split(text[1:-1])]
    if text.startswith("{") and text.endswith("}"):
        return {_scalar(k.strip()): _scalar(v.strip()) for k, _, v in (p.partition(":") for p in _split(text[1:-1]))}
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None}.get(text, text)


def role_map(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """(policy_id, stakeholder_type, kg_role) of the configuration's role_map."""
    rows = [(p, t, r) for p, types in config["role_map"].items() for t, r in types.items()]
    return spark.createDataFrame(rows, "policy_id string, stakeholder_type string, kg_role string")


def ground_truth(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """(policy_id, phase, target, metric, gt, lo, hi) of the configuration's gt_map; a policy may be absent from it."""
    rows = [(p, m["phase"], m["var"], name, float(m["gt"]), float(m["range"][0]), float(m["range"][1])) for p, metrics in config.get("gt_map", {}).items() for name, m in metrics.items()]
    return spark.createDataFrame(rows, "policy_id string, phase string, target string, metric string, gt double, lo double, hi double")
