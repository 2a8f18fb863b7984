"""Declarative rules: loaded from YAML, validated, and compiled to bitmaps over a VARIANT of properties.

Every distinct test of all rules (a path, an operator, a value) is evaluated once for a row and kept as a bit; conditions
are tests of masks. The condition language has Python's values and two truth values; SQL has three. So every test is made
null-free, and looks at the kind of a value first, because VARIANT casts are lenient ('5' is a number to a cast, but not
to the language).
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisark import dims
from palisark.operators import rule_pack

MAX_DEPTH = 10
MAX_FILE_BYTES = 1 << 20
MAX_RULES_PER_FILE = 100
MAX_RULES = 1000
LOGICAL = ("all_of", "any_of", "none_of", "not")
REQUIRED = ("id", "title", "stride_category", "severity", "resource_type", "condition")


class RuleError(ValueError):
    """A rule file that can't be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    description: str
    stride_category: str
    severity: str
    resource_type: str
    condition: dict
    mitigation: str = ""
    metadata: dict | None = None

    @property
    def techniques(self) -> list[str]:
        return list((self.metadata or {}).get("mitre", {}).get("techniques", []))

    @property
    def tactics(self) -> list[str]:
        told = list((self.metadata or {}).get("mitre", {}).get("tactics", []))
        return told or sorted({t for x in self.techniques for t in dims.TECHNIQUE_TACTICS.get(x, [])})


def validated(raw: object, where: str) -> Rule:
    """One entry of a rule file as a rule."""
    if not isinstance(raw, dict):
        raise RuleError(f"{where}: a rule must be a mapping")
    if missing := [k for k in REQUIRED if not raw.get(k)]:
        raise RuleError(f"{where}: missing {', '.join(missing)}")
    if raw["stride_category"] not in dims.STRIDE_CATEGORIES:
        raise RuleError(f"{where}: unknown STRIDE category {raw['stride_category']!r}")
    if raw["severity"] not in dims.SEVERITIES:
        raise RuleError(f"{where}: unknown severity {raw['severity']!r}")
    if not isinstance(raw["condition"], dict):
        raise RuleError(f"{where}: a condition must be a mapping")
    text = lambda k: str(raw.get(k) or "").strip()
    return Rule(
        text("id"), text("title"), text("description"), raw["stride_category"], raw["severity"], text("resource_type"),
        raw["condition"], text("mitigation"), raw.get("metadata") or {},
    )


def load_file(path: str | Path) -> list[Rule]:
    path = Path(path)
    if path.is_symlink():
        raise RuleError(f"{path}: symbolic links are refused")
    if path.stat().st_size > MAX_FILE_BYTES:
        raise RuleError(f"{path}: larger than {MAX_FILE_BYTES} bytes")
    data = yaml.safe_load(path.read_text(encoding="utf-8"))
    entries = data.get("rules", []) if isinstance(data, dict) else data or []
    if not isinstance(entries, list):
        raise RuleError(f"{path}: rules must be a list")
    if len(entries) > MAX_RULES_PER_FILE:
        raise RuleError(f"{path}: more than {MAX_RULES_PER_FILE} rules")
    return [validated(x, f"{path}#{i}") for i, x in enumerate(entries)]


def load(extra_paths: Iterable[str | Path] = (), builtin: bool = True) -> list[Rule]:
    """The built-in rules and those of files or folders (in sorted order); an id that repeats is an error."""
    found = [validated(x, "built-in") for x in rule_pack.builtin()] if builtin else []
    for path in map(Path, extra_paths):
        files = sorted(p for p in path.rglob("*") if p.suffix in (".yml", ".yaml")) if path.is_dir() else [path]
        for f in files:
            found += load_file(f)
    seen: set[str] = set()
    for r in found:
        if r.id in seen:
            raise RuleError(f"rule id {r.id} repeats")
        seen.add(r.id)
    if len(found) > MAX_RULES:
        raise RuleError(f"more than {MAX_RULES} rules")
    return found


# The condition language as SQL text: one text is parsed at once, where a tree of columns costs a call for each node.


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _double(x: float) -> str:
    return f"CAST({_quoted(repr(float(x)))} AS DOUBLE)"


def _member(value: str, key: str) -> str:
    """A mapping's value; a path expression can't write every key."""
    if re.fullmatch(r"[^'\"?\[\]\\]+", key):
        return f"try_variant_get({value}, {_quoted(f"$['{key}']")}, 'variant')"
    return f"try_element_at(try_variant_get({value}, '$', 'map<string,variant>'), {_quoted(key)})"


def path_sql(value: str, path: str) -> str:
    """The value at a dotted path: keys of mappings, places of lists (from the end if negative). Null if there is none."""
    for part in path.split("."):
        by_key = _member(value, part)
        if re.fullmatch(r"\d+", part):
            value = f"coalesce({by_key}, try_variant_get({value}, '$[{int(part)}]', 'variant'))"
        elif re.fullmatch(r"-\d+", part):
            value = f"coalesce({by_key}, try_element_at(try_variant_get({value}, '$', 'array<variant>'), {int(part)}))"
        else:
            value = by_key
    return value


def kind_sql(v: str) -> str:
    """What Python would call the value: none, bool, int, float, str, list or dict."""
    return f"""CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN 'none' WHEN schema_of_variant({v}) = 'BOOLEAN' THEN 'bool'
        WHEN schema_of_variant({v}) IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') THEN 'int'
        WHEN startswith(schema_of_variant({v}), 'DECIMAL') OR schema_of_variant({v}) IN ('DOUBLE', 'FLOAT') THEN 'float'
        WHEN schema_of_variant({v}) = 'STRING' THEN 'str' WHEN startswith(schema_of_variant({v}), 'ARRAY') THEN 'list'
        WHEN startswith(schema_of_variant({v}), 'OBJECT') THEN 'dict' ELSE 'other' END"""


class Value:
    """The names of a VARIANT and its kind; what it is as a number, text, list or keys (null where it isn't one)."""

    def __init__(self, v: str, kind: str, depth: int = 0):
        self.v, self.kind, self.depth = v, kind, depth
        self.number = f"CASE WHEN {kind} = 'bool' THEN CAST(try_variant_get({v}, '$', 'boolean') AS DOUBLE) WHEN {kind} IN ('int', 'float') THEN try_variant_get({v}, '$', 'double') END"
        self.text = f"CASE WHEN {kind} = 'str' THEN try_variant_get({v}, '$', 'string') END"
        self.items = f"CASE WHEN {kind} = 'list' THEN try_variant_get({v}, '$', 'array<variant>') END"
        self.keys = f"CASE WHEN {kind} = 'dict' THEN map_keys(try_variant_get({v}, '$', 'map<string,variant>')) END"

    def some(self, array: str, test: Callable[[Value], str]) -> str:
        """Whether one of the VARIANTs of ``array`` passes; each is bound, with its kind, for the test."""
        name = f"x{self.depth}"
        inner = Value(f"{name}.v", f"{name}.k", self.depth + 1)
        return f"coalesce(exists(transform({array}, w -> named_struct('v', w, 'k', {kind_sql('w')})), {name} -> {test(inner)}), false)"


def equals(v: Value, expected: object) -> str:
    """Python's ==: numbers and truth values compare by value, strings with strings only, containers by their items."""
    if expected is None:
        return f"({v.kind} = 'none')"
    if isinstance(expected, bool | int | float):
        return f"coalesce({v.number} = {_double(expected)}, false)"
    if isinstance(expected, str):
        return f"coalesce({v.text} = {_quoted(expected)}, false)"
    if isinstance(expected, list):
        parts = [f"coalesce({v.kind} = 'list' AND size({v.items}) = {len(expected)}, false)"]
        parts += [v.some(f"array(get({v.items}, {i}))", lambda x, e=e: equals(x, e)) for i, e in enumerate(expected)]
        return f"({' AND '.join(parts)})"
    if isinstance(expected, dict):
        parts = [f"coalesce({v.kind} = 'dict' AND size({v.keys}) = {len(expected)}, false)"]
        for key, e in expected.items():
            # A key with the value null and no key at all are told apart by the keys.
            parts.append(f"coalesce(array_contains({v.keys}, {_quoted(str(key))}), false)")
            parts.append(v.some(f"array({_member(v.v, str(key))})", lambda x, e=e: equals(x, e)))
        return f"({' AND '.join(parts)})"
    return "false"


def _contains(v: Value, expected: object) -> str:
    """A string holds a substring, a list an equal item, a mapping a key; nothing else holds anything."""
    out = v.some(v.items, lambda x: equals(x, expected))
    if isinstance(expected, str):
        text = _quoted(expected)
        out = f"({out} OR coalesce(contains({v.text}, {text}), false) OR coalesce(array_contains({v.keys}, {text}), false))"
    return out


def _empty(v: Value) -> str:
    return (
        f"({v.kind} = 'none' OR coalesce({v.text} = '', false) OR {v.kind} = 'list' AND coalesce(size({v.items}) = 0, false)"
        f" OR {v.kind} = 'dict' AND coalesce(size({v.keys}) = 0, false))"
    )


def truthy(v: Value) -> str:
    return f"NOT ({_empty(v)} OR coalesce({v.number} = CAST(0 AS DOUBLE), false))"


def truthy_at(props: str, path: str) -> Column:
    """Whether the value at a path of the VARIANT column ``props`` is true to Python."""
    one = f"array({path_sql(props, path)})"
    return F.expr(Value("", "'none'").some(one, truthy))


def _test(op: str, expected: object, v: Value) -> str:
    """A leaf of a condition, null-free."""
    if op == "exists":
        return f"({v.kind} <> 'none')"
    if op == "equals":
        return equals(v, expected)
    if op == "contains":
        return _contains(v, expected)
    if op == "matches_any":
        return "(" + (" OR ".join(equals(v, x) for x in expected) or "false") + ")"
    if op in ("greater_than", "less_than"):
        return f"coalesce({v.number} {'>' if op == 'greater_than' else '<'} {_double(expected)}, false)"
    if op == "is_true":
        return f"({truthy(v)})"
    return _empty(v)  # is_empty


# Conditions as tests of bits


@dataclass(frozen=True)
class Leaf:
    """A test of the value at a path. Its key tells equal ones: of all rules each is evaluated once for a row."""

    path: str
    op: str
    key: str
    expected: object = field(compare=False)


def _leaf(path: str, op: str, expected: object) -> object:
    """A check as True or False, a leaf, or ("not", leaf): opposites share one leaf."""
    flipped = {"not_exists": "exists", "not_equals": "equals", "not_contains": "contains"}
    sure = op in ("exists", "not_exists", "is_empty")
    if op == "property_path":
        return _leaf(str(expected), "exists", True)
    if op == "is_true" and not isinstance(expected, bool) or op == "matches_any" and not isinstance(expected, list):
        return False
    if op in ("greater_than", "less_than") and not isinstance(expected, bool | int | float):
        return False
    if op not in ("exists", "not_exists", "equals", "not_equals", "contains", "not_contains", "matches_any", "greater_than", "less_than", "is_true", "is_empty"):
        return False  # unknown operators fail closed
    negative = (op in flipped) != ((sure or op == "is_true") and not expected)
    value = True if sure or op == "is_true" else expected
    leaf = Leaf(path, flipped.get(op, op), json.dumps([type(value).__name__, value], sort_keys=True, default=str), value)
    return ("not", leaf) if negative else leaf


def tree(condition: object, depth: int = 0) -> object:
    """A condition as True, False, a leaf, ("not", tree), or ("and" or "or", trees).

    A logical key rules out its siblings (the first of all_of, any_of, none_of, not counts); conditions deeper than
    MAX_DEPTH are false.
    """
    if depth > MAX_DEPTH or not isinstance(condition, dict):
        return False
    op = next((k for k in LOGICAL if k in condition), None)
    if op == "not":
        return ("not", tree(condition[op], depth + 1)) if isinstance(condition[op], dict) else False
    if op:
        if not isinstance(condition[op], list):
            return False
        parts = [tree(c, depth + 1) for c in condition[op]]
        return ("and", parts) if op == "all_of" else ("or", parts) if op == "any_of" else ("not", ("or", parts))
    parts = []
    for path, check in condition.items():
        parts += [_leaf(str(path), name, x) for name, x in check.items()] if isinstance(check, dict) else [_leaf(str(path), "equals", check)]
    return ("and", parts)


def leaves_of(node: object) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    elif isinstance(node, tuple):
        for x in node[1] if isinstance(node[1], list) else [node[1]]:
            yield from leaves_of(x)


#: Bits of a word of the bitmap.
WORD = 62


class Bitmap:
    """The distinct leaves of rules, as bits of words.

    A word holds leaves that the same prefixes of resource types need, and is made for rows of these types only: a row
    evaluates the leaves of the rules that may concern it, each once, however many rules share it.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.rules = sorted(rules, key=lambda r: (r.resource_type, r.id))
        self.trees = {r.id: tree(r.condition) for r in self.rules}
        owners: dict[Leaf, set[str]] = {}
        for r in self.rules:
            for leaf in leaves_of(self.trees[r.id]):
                owners.setdefault(leaf, set()).add(r.resource_type)
        shared: dict[tuple[str, ...], list[Leaf]] = {}
        for leaf, prefixes in owners.items():
            shared.setdefault(tuple(sorted(prefixes)), []).append(leaf)
        self.words = [(p, group[i : i + WORD]) for p, group in sorted(shared.items()) for i in range(0, len(group), WORD)]
        self.place = {leaf: (w, 1 << b) for w, (_, group) in enumerate(self.words) for b, leaf in enumerate(group)}

    def word_sql(self, w: int, kind_of: str, props: str) -> str:
        prefixes, group = self.words[w]
        paths = sorted({leaf.path for leaf in group})
        at = {p: Value(f"s[{i}].v", f"s[{i}].k") for i, p in enumerate(paths)}
        bits = " | ".join(f"CASE WHEN {_test(leaf.op, leaf.expected, at[leaf.path])} THEN {self.place[leaf][1]}L ELSE 0L END" for leaf in group)
        values = f"transform(array({', '.join(path_sql(props, p) for p in paths)}), v -> named_struct('v', v, 'k', {kind_sql('v')}))"
        concerned = " OR ".join(f"startswith({kind_of}, {_quoted(p)})" for p in prefixes)
        return f"CASE WHEN {concerned} THEN get(transform(array({values}), s -> {bits}), 0) ELSE 0L END"

    def test_sql(self, node: object, negative: bool = False) -> str:
        """A tree as tests of the words ``b``: leaves side by side that lie in one word are one test of a mask."""
        if isinstance(node, bool):
            return "true" if node != negative else "false"
        if isinstance(node, Leaf):
            node = ("and", [node])
        op, parts = node
        if op == "not":
            return self.test_sql(parts, not negative)
        every = (op == "and") != negative
        masks: dict[int, list[int]] = {}
        tests = []
        for x in parts:
            sign = negative
            while isinstance(x, tuple) and (x[0] == "not" or len(x[1]) == 1):
                x, sign = (x[1], not sign) if x[0] == "not" else (x[1][0], sign)
            if isinstance(x, Leaf):
                w, bit = self.place[x]
                own = masks.setdefault(w, [0, 0])
                own[sign] |= bit
            else:
                tests.append(self.test_sql(x, sign))
        for w, (yes, no) in masks.items():
            if every:
                tests.append("false" if yes & no else f"(b[{w}] & {yes | no}L) = {yes}L")
            else:  # one of the bits that should be set is, or one of those that shouldn't isn't
                tests += [f"(b[{w}] & {yes}L) <> 0L"] * bool(yes) + [f"(b[{w}] & {no}L) <> {no}L"] * bool(no)
        if not tests:
            return "true" if every else "false"
        return "(" + (" AND " if every else " OR ").join(tests) + ")"

    def fired_sql(self, kind_of: str, props: str) -> str:
        """The ids of the rules that fire, as an array."""
        none = "CAST(array() AS ARRAY<STRING>)"
        if not self.rules:
            return none
        words = ", ".join(self.word_sql(w, kind_of, props) for w in range(len(self.words))) or "0L"
        hits = []
        for prefix, part in itertools.groupby(self.rules, key=lambda r: r.resource_type):
            ids = ", ".join(f"CASE WHEN {self.test_sql(self.trees[r.id])} THEN {_quoted(r.id)} END" for r in part)
            hits.append(f"CASE WHEN startswith({kind_of}, {_quoted(prefix)}) THEN array_compact(array({ids})) ELSE {none} END")
        return f"flatten(transform(array(array({words})), b -> flatten(array({', '.join(hits)}))))"


def matches(rows: DataFrame, rules: list[Rule], type_col: str = "resource_type", props_col: str = "properties") -> DataFrame:
    """``rows`` with a rule_id for each rule that fires.

    One scan and no join. A row's leaves become a bitmap, its rules are tests of masks, and the ids of those that hold are
    exploded. Lambdas bind the values and the words; they aren't part of the generated code, so that any number of rules
    stays within a method's size.
    """
    return rows.withColumn("rule_id", F.explode(F.expr(Bitmap(rules).fired_sql(f"`{type_col}`", f"`{props_col}`"))))


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """The rules as a dimension table; at most MAX_RULES rows."""
    rows = [
        (r.id, r.title, r.description, r.stride_category, r.severity, r.mitigation, json.dumps(r.metadata or {}), r.techniques, r.tactics, i)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, title string, description string, stride_category string, severity string, mitigation string, metadata_json string, "
        "mitre_techniques array<string>, mitre_tactics array<string>, rule_ord int",
    )


def threats(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """A threat for each node and rule that fires on it (columns: ``schemas.THREAT_COLUMNS``)."""
    found = matches(nodes, rules).join(F.broadcast(rule_table(nodes.sparkSession, rules)), "rule_id")
    return found.select(
        "source_file", dims.hash_id(F.col("rule_id"), F.col("id")).alias("id"), "title", "description", "stride_category", "severity",
        F.lit("rule").alias("source"), "resource_type", F.col("id").alias("resource_address"), "mitigation", "rule_id",
        F.lit(1.0).alias("confidence"), F.parse_json("metadata_json").alias("metadata"), "mitre_techniques", "mitre_tactics",
        dims.severity_rank(F.col("severity")).alias("sev_rank"),
    )
