"""Nested contracts: schemas as rule rows, gathered by schema and joined with the documents, which are judged at any depth in their own rows."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.functions.json_text import read
from foldlog.session import keep

# The types that a schema may name, and what its root must have.
TYPES = ["string", "number", "integer", "boolean", "object", "array", "null"]
ROOT_FIELDS = ["title", "description", "type", "required", "properties"]
PROBLEMS = "array<struct<path: string, problem: string>>"
#: Schemas that a task keeps compiled, at most but for one batch.
MOST_CONTRACTS = 1_000
RULES = "array<struct<path: string, parent: string, key: string, types: array<string>, required: boolean, closed: boolean, problem: string>>"


def kinds_of(value: object) -> list[str]:
    """The types that a value has; an integer is a number too."""
    if isinstance(value, bool):
        return ["boolean"]
    if isinstance(value, int):
        return ["integer", "number"]
    named = {str: "string", float: "number", dict: "object", list: "array", type(None): "null"}
    return [named[type(value)]]


def joined_path(path: str, key: str) -> str:
    return f"{path}.{key}" if path else key


def nodes_of(text: str | None, deepest: int) -> list[tuple] | None:
    """(path, parent, key, kinds) of a document and of the keys of its objects down to a depth; null for what is no JSON."""
    try:
        todo = [("", None, "", read(text or ""), 0)]
    except ValueError:
        return None
    out = []
    while todo:
        path, parent, key, value, depth = todo.pop()
        out.append((path, parent, key, kinds_of(value)))
        if isinstance(value, dict) and depth < deepest:
            todo.extend((joined_path(path, k), path, k, v, depth + 1) for k, v in value.items())
    return out


def rules_of(text: str | None) -> list[tuple]:
    """(path, parent, key, types, required, closed, problem) of a schema's definitions; what is wrong with one stands in its problem."""
    try:
        root = read(text or "")
    except ValueError:
        root = None
    if not isinstance(root, dict):
        return [("", None, "", [], False, False, "schema is no object")]
    problems = [("", f"missing {f}") for f in ROOT_FIELDS if f not in root]
    out, todo = [], [("", None, "", root, True)]
    while todo:
        path, parent, key, given, required = todo.pop()
        if not isinstance(given, dict):
            out.append((path, parent, key, [], required, False, "definition is no object"))
            continue
        named = given.get("type")
        types = named if isinstance(named, list) else [named]
        if not types or any(t not in TYPES for t in types):
            problems.append((path, "unsupported or missing type"))
            types = []
        elif not path and "object" not in types:
            problems.append((path, "root is no object"))
        inner, wanted = given.get("properties", {}), given.get("required", [])
        if "object" in types:
            if not isinstance(inner, dict):
                problems.append((path, "properties are no object"))
                inner = {}
            if not isinstance(wanted, list) or not all(isinstance(x, str) for x in wanted):
                problems.append((path, "required is no array of strings"))
                wanted = []
            problems += [(joined_path(path, x), "required and not declared") for x in wanted if x not in inner]
            todo.extend((joined_path(path, k), path, k, v, k in wanted) for k, v in inner.items())
        closed = given.get("additionalProperties", True)
        if not isinstance(closed, bool):
            problems.append((path, "additionalProperties is no boolean"))
        out.append((path, parent, key, types, required, closed is False, None))
    return out + [(path, None, None, [], False, False, p) for path, p in problems]


def _rows(text: Column, of, kind: str) -> Column:
    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([of(x) for x in b], dtype=object)

    return apply(text)


def compiled(schemas: DataFrame, name_col: str, json_col: str) -> DataFrame:
    """(schema, path, parent, key, types, required, closed, problem): a row a definition, and a row a problem of the schema."""
    return schemas.select(F.col(name_col).alias("schema"), F.explode(_rows(F.col(json_col), rules_of, RULES)).alias("r")).select("schema", "r.*")


def schema_problems(rules: DataFrame) -> DataFrame:
    return rules.where("problem is not null").select("schema", "path", "problem")


class Contract:
    """The rules of one schema by path, and what breaks them. Paths may stand twice, as keys with dots read as nested ones."""

    def __init__(self, rules: list[dict]) -> None:
        self.types, self.closed, self.needed = defaultdict(list), defaultdict(list), defaultdict(list)
        for r in rules:
            self.types[r["path"]].append(set(r["types"]))
            self.closed[r["path"]].append(r["closed"])
            if r["required"] and r.get("parent") is not None:
                self.needed[r["parent"]].append(r["path"])
        # places further down than any rule's keys are not listed, as nothing can be wrong there
        self.deepest = max((r["path"].count(".") for r in rules), default=-1) + 2

    def broken(self, text: str | None) -> list[tuple[str, str]]:
        """(path, problem) of a document. A place counts if its parent is an object that the rules enter; the root counts always."""
        nodes = nodes_of(text, self.deepest)
        if nodes is None:
            return [("", "invalid")]
        there, out = {path for path, *_ in nodes}, []
        for path, parent, _, kinds in nodes:
            above = [None] if parent is None else self.closed.get(parent, ())
            known = self.types.get(path)
            for closed in above:
                if known is None:
                    if closed:
                        out.append((path, "unknown"))
                    continue
                out += [(path, "type") for types in known if types and types.isdisjoint(kinds)]
            if known is not None and "object" in kinds:
                out += [(need, "missing") for types in known if "object" in types for need in self.needed.get(path, ()) if need not in there]
        return out


def nested_violations(df: DataFrame, rules: DataFrame, id_col: str, schema_col: str, json_col: str) -> DataFrame:
    """(id, path, problem) of documents (id, schema, JSON text) that break their schema's rules at any depth.

    Problems: `invalid` for what is no JSON, `type`, `missing`, `unknown` where an object is closed. Below a value of the
    wrong type nothing is looked at; arrays are not entered. Documents of a schema without rules have no problems. Rules without a type
    let every value pass. Null texts are no JSON. Documents of any depth are read; repeated and null ids are judged each by their own text.
    Keys with dots read as nested ones. Rules are gathered a row a schema and written once, so documents are moved only where
    the rules are too many to go to every task.
    """
    real = rules.where("problem is null and key is not null")
    gathered = keep(real.groupBy("schema").agg(F.to_json(F.collect_list(F.struct("path", "parent", "types", "required", "closed"))).alias("rules")))

    @F.pandas_udf(PROBLEMS)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        contracts: dict[str | None, Contract] = {}
        for told, texts in batches:
            # of many schemas a batch's are kept
            if len(contracts) > MOST_CONTRACTS:
                contracts.clear()
            out = []
            for named, text in zip(told, texts):
                if (contract := contracts.get(named)) is None:
                    contract = contracts[named] = Contract(json.loads(named) if named else [])
                out.append(contract.broken(text))
            yield pd.Series(out, dtype=object)

    read_rows = df.select(F.col(id_col).alias("id"), F.col(schema_col).alias("schema"), F.col(json_col).alias("json"))
    judged = read_rows.join(gathered, "schema", "left").select("id", judge(F.col("rules"), F.col("json")).alias("found"))
    return judged.select("id", F.explode("found").alias("v")).select(F.col("id").alias(id_col), "v.path", "v.problem")
