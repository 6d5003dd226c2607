"""Catalogues of requirements in files `<key>/<version>.json` (or .yaml, where a YAML reader is installed), validated when read.

A check is a tree: metric, metric_period and pattern are leaves, any_of and conditional have checks below them. It is flattened to
nodes, so that all companies and requirements are evaluated together, level by level.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from importlib import resources
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LEAVES = ("metric", "metric_period", "pattern")
TYPES = (*LEAVES, "any_of", "conditional")


@dataclass(frozen=True)
class Node:
    """One check of an element's tree; `parent` is None at the root, `role` is checks, when or then below it."""

    set_id: str
    code: str
    element: str
    weight: float
    node: int
    parent: int | None
    role: str
    ordinal: int
    depth: int
    type: str
    metric_keys: tuple[str, ...] = ()
    weak_metric_keys: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    context: tuple[str, ...] = ()


def _demand(holds: Any, text: str) -> None:
    if not holds:
        raise ValueError(text)


def validate(check: dict, where: str) -> None:
    """Raise ValueError unless a check, and all below it, has what its type needs and regular expressions that compile."""
    kind = check.get("type")
    _demand(kind in TYPES, f"{where}: unknown check type {kind!r}")
    _demand(kind not in ("metric", "metric_period") or check.get("metric_keys"), f"{where}: {kind} needs metric_keys")
    _demand(kind != "pattern" or check.get("patterns"), f"{where}: pattern needs patterns")
    _demand(kind != "any_of" or check.get("checks"), f"{where}: any_of needs checks")
    _demand(kind != "conditional" or (check.get("when") and check.get("then")), f"{where}: conditional needs when and then")
    for pattern in [*check.get("patterns", []), *check.get("context", [])]:
        try:
            re.compile(pattern, re.IGNORECASE)
        except re.error as error:
            raise ValueError(f"{where}: {pattern!r} is no regular expression: {error}") from error
    for role, _, below in _below(check):
        validate(below, f"{where}/{role}")


def _below(check: dict) -> list[tuple[str, int, dict]]:
    if check["type"] == "any_of":
        return [("checks", k, c) for k, c in enumerate(check["checks"])]
    return [(role, k, check[role]) for k, role in enumerate(("when", "then"))] if check["type"] == "conditional" else []


def parse(text: str, path: str) -> dict:
    """A catalogue of a file's text; its path must end in <key>/<version>.<ending>."""
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml  # optional: JSON files need none

        found = yaml.safe_load(text)
    folder, name = path.replace("\\", "/").split("/")[-2:]
    _demand(found.get("key") == folder and found.get("version") == name.rsplit(".", 1)[0], f"{path}: the place must be <key>/<version>")
    for requirement in found.get("requirements", []):
        keys = [e["key"] for e in requirement["elements"]]
        _demand(len(keys) == len(set(keys)), f"{path}: {requirement['code']} repeats an element")
        _demand(1 <= requirement.get("importance", 2) <= 3, f"{path}: {requirement['code']} has an importance out of 1 to 3")
        for element in requirement["elements"]:
            validate(element["check"], f"{path}: {requirement['code']}/{element['key']}")
    return found


def read_folder(spark: SparkSession, folder: str) -> list[dict]:
    """The catalogues below a folder in any store that Spark reads, in the order of their paths. Catalogues are written by hand, so
    they are driver-sized."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    rows = files.filter(F.col("path").rlike(r"\.(json|ya?ml)$")).orderBy("path").collect()
    return [parse(r["value"], r["path"]) for r in rows]


def packaged() -> list[dict]:
    """The catalogues that come with the library."""
    root = resources.files("cairnlake").joinpath("catalogue")
    files = sorted((folder.name, f.name) for folder in root.iterdir() if folder.is_dir() for f in folder.iterdir() if f.name.endswith(".json"))
    return [parse(root.joinpath(folder, name).read_text(encoding="utf-8"), f"{folder}/{name}") for folder, name in files]


def flatten(catalogues: list[dict]) -> list[Node]:
    """All checks as nodes with running numbers, parents before what is below them."""
    out: list[Node] = []

    def add(check: dict, parent: int | None, role: str, ordinal: int, depth: int, named: tuple) -> None:
        at = len(out)
        lists = [tuple(check.get(c) or ()) for c in ("metric_keys", "weak_metric_keys", "patterns", "context")]
        out.append(Node(*named, at, parent, role, ordinal, depth, check["type"], *lists))
        for below_role, k, below in _below(check):
            add(below, at, below_role, k, depth + 1, named)

    for catalogue in catalogues:
        for requirement in catalogue["requirements"]:
            for element in requirement["elements"]:
                named = (f"{catalogue['key']}@{catalogue['version']}", requirement["code"], element["key"], float(element.get("weight", 1.0)))
                add(element["check"], None, "root", 0, 0, named)
    return out
