"""Evaluation suites and rule sets from JSON or YAML files, as tables. A file holds a list, or an object with the list under a key."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lexloom.exceptions import InvalidFile

CASES = "case_id string, doc_type string, input_text string, field string, value string, weight double"
RULES = "rule_id string, rule_ord int, clause_type string, severity string, description string, required array<string>, forbidden array<string>, required_pattern string, forbidden_pattern string, if_missing boolean"


def _entries(path: str, key: str) -> list[dict]:
    p = Path(path)
    try:
        if p.suffix.lower() in (".yaml", ".yml"):
            import yaml

            data = yaml.safe_load(p.read_text(encoding="utf-8"))
        elif p.suffix.lower() == ".json":
            data = json.loads(p.read_text(encoding="utf-8"))
        else:
            raise InvalidFile(f"{path}: neither JSON nor YAML")
    except InvalidFile:
        raise
    except Exception as e:
        raise InvalidFile(f"{path}: {e}") from e
    rows = data.get(key) if isinstance(data, dict) else data
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise InvalidFile(f"{path}: no list of objects")
    return rows


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row for every expected field of every case."""
    rows = []
    for c in _entries(path, "cases"):
        if "id" not in c:
            raise InvalidFile(f"{path}: a case without id")
        weights = c.get("field_weights") or {}
        for f, v in (c.get("expected_fields") or {}).items():
            rows.append((str(c["id"]), c.get("doc_type"), c.get("input_text"), f, None if v is None else v if isinstance(v, str) else json.dumps(v), float(weights.get(f, 1.0))))
    return spark.createDataFrame(rows, CASES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules in order, ready for ``apply_rules``."""
    rows = []
    for n, r in enumerate(_entries(path, "rules")):
        if not r.get("id") or not r.get("clause_type"):
            raise InvalidFile(f"{path}: rule {n} lacks id or clause_type")
        rows.append(
            (r["id"], n, r["clause_type"], r.get("severity"), r.get("description"), list(r.get("required_keywords") or []), list(r.get("forbidden_keywords") or []), r.get("required_pattern") or "", r.get("forbidden_pattern") or "", bool(r.get("flag_if_missing", False)))
        )
    return spark.createDataFrame(rows, RULES)


def write_rules(rules: DataFrame, path: str) -> None:
    """A rule set back to JSON; rule sets are as small as their authors made them."""
    names = {"rule_id": "id", "required": "required_keywords", "forbidden": "forbidden_keywords", "if_missing": "flag_if_missing"}
    rows = [{names.get(k, k): v for k, v in r.asDict().items() if k != "rule_ord"} for r in rules.orderBy("rule_ord").collect()]
    Path(path).write_text(json.dumps({"rules": rows}, ensure_ascii=False, indent=1), encoding="utf-8")
