"""JSON out of free text: candidates, repair, loading; and flat paths of nested records."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def candidates(text: str) -> list[str]:
    """Fenced blocks, then balanced objects (outside strings), then all from the first to the last brace."""
    out = [m.strip() for m in _FENCE.findall(text)]
    depth, start, quoted, escaped = 0, -1, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    if "{" in text and "}" in text:
        out.append(text[text.index("{") : text.rindex("}") + 1])
    return out


def repaired(text: str) -> str:
    """Without comments, control characters and commas before a closing bracket."""
    text = re.sub(r"(?m)^\s*//.*$|/\*.*?\*/", "", text, flags=re.S if "/*" in text else 0)
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return re.sub(r",\s*([}\]])", r"\1", text)


def load_object(text: str | None) -> dict:
    """The first object that can be read, as JSON, repaired JSON or a Python literal; else an empty one."""
    for c in candidates(text or ""):
        for attempt in (c, repaired(c)):
            for read in (lambda t: json.JSONDecoder().raw_decode(t.lstrip())[0], ast.literal_eval):
                try:
                    got = read(attempt)
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    continue
                if isinstance(got, dict):
                    return got
    return {}


def tolerant_json(column: Column) -> Column:
    """Each text's object as plain JSON."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: json.dumps(load_object(t), ensure_ascii=False, sort_keys=True))

    return run(column)


def flat_paths(column: Column) -> Column:
    """Leaves of a JSON object with their paths (array of path, value): names by dots, places in brackets."""

    def walk(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}" if path else str(k))
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, f"{path}[{i}]")
        elif value is not None:
            yield {"path": path, "value": value if isinstance(value, str) else json.dumps(value)}

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: list(walk(load_object(t), "")))

    return run(column)


def record_key(path: Column) -> Column:
    return F.regexp_extract(path, r"^((?:education|experience|research|activities|projects)\[[0-9]+\])", 1)


def structural_category(path: Column) -> Column:
    """The invariant that a path belongs to; empty for none."""
    return (
        F.when(path.rlike(r"\.(?:organization|institution)$"), "organization").when(path.rlike(r"\.role$"), "role")
        .when(path.rlike(r"\.period$") | (path == "meta.work_experience"), "period").when(path.startswith("education["), "education")
        .when(path.rlike(r"^(?:certifications|awards)\["), "credential").when(path.startswith("skills.items["), "skill_tool").otherwise("")
    )
