"""Symbols, calls and imports of TypeScript sources, by a scanner of tokens and brace depth."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Extensions that have a graph.
GRAPH_EXTENSIONS = (".ts", ".tsx")

_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?\*/|\s+)|(?P<string>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")|(?P<template>`)|(?P<regex>(?<=[=(,:\[!&|?{};\n])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[a-z]*)|(?P<name>[A-Za-z_$#][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\?\.|\.\.\.|.)""",
    re.S | re.X,
)
_KEYWORDS = frozenset("if for while switch catch return typeof instanceof new delete void in of do else try finally throw await yield case import export function class super with assert".split())


@dataclass
class Extract:
    symbols: list[tuple[str, str, int]] = field(default_factory=list)  # name, kind, line
    calls: list[tuple[str, str, int]] = field(default_factory=list)  # caller, callee, line
    imports: list[tuple[str, str, str, int]] = field(default_factory=list)  # local name, exported name, module, line
    failed: bool = False


def _tokens(text: str, line: int = 1) -> list[tuple[str, str, int]]:
    """(kind, text, line); the code in a template's ${} takes part, its text does not."""
    out, at, n = [], 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        kind, value = m.lastgroup, m.group()
        if kind == "template":
            end = at + 1
            start_line = line
            while end < n and text[end] != "`":
                if text[end] == "\\":
                    end += 2
                elif text.startswith("${", end):
                    depth, k = 1, end + 2
                    while k < n and depth:
                        depth += {"{": 1, "}": -1}.get(text[k], 0)
                        k += 1
                    out += _tokens(text[end + 2 : k - 1], start_line + text.count("\n", at, end))
                    end = k
                else:
                    end += 1
            out.append(("string", "``", start_line))
            line += text.count("\n", at, min(end + 1, n))
            at = end + 1
            continue
        if kind != "skip":
            out.append((kind, value, line))
        line += value.count("\n")
        at = m.end()
    return out


def _close(ts: list[tuple[str, str, int]], i: int, opening: str, closing: str) -> int:
    """Index of the token that closes the one at i, or of the last token."""
    depth = 0
    for k in range(i, len(ts)):
        if ts[k][0] == "mark":
            depth += (ts[k][1] == opening) - (ts[k][1] == closing)
            if depth == 0:
                return k
    return len(ts) - 1


def _is_arrow(ts: list[tuple[str, str, int]], i: int) -> bool:
    """Whether the expression that starts at i is an arrow function or a function expression."""
    if i < len(ts) and ts[i][1] == "async":
        i += 1
    if i >= len(ts):
        return False
    if ts[i][1] == "function":
        return True
    if ts[i][1] == "<":
        i = _close(ts, i, "<", ">") + 1
        if i >= len(ts):
            return False
    if ts[i][0] == "name":
        return i + 1 < len(ts) and ts[i + 1][1] == "=>"
    if ts[i][1] != "(":
        return False
    k = _close(ts, i, "(", ")") + 1
    if k < len(ts) and ts[k][1] == ":":  # a return type
        depth = 0
        while k < len(ts) and not (ts[k][1] == "=>" and depth == 0) and ts[k][1] not in ";":
            depth += (ts[k][1] in "([{<") - (ts[k][1] in ")]}>")
            k += 1
    return k < len(ts) and ts[k][1] == "=>"


def _imports(ts: list[tuple[str, str, int]], i: int, out: Extract) -> int:
    line, k = ts[i][2], i + 1
    if k < len(ts) and ts[k][1] in "(.":
        return i + 1
    names: list[tuple[str, str]] = []
    if k < len(ts) and ts[k][1] == "type" and k + 1 < len(ts) and ts[k + 1][1] not in (",", "from"):
        k += 1
    while k < len(ts) and ts[k][1] != "from" and ts[k][0] != "string" and ts[k][1] != ";":
        if ts[k][1] == "*" and k + 2 < len(ts) and ts[k + 1][1] == "as":
            names.append((ts[k + 2][1], ts[k + 2][1]))
            k += 3
        elif ts[k][1] == "{":
            end = _close(ts, k, "{", "}")
            part = [t for t in ts[k + 1 : end]]
            spec: list[str] = []
            for t in [*part, ("mark", ",", 0)]:
                if t[1] != ",":
                    spec.append(t[1])
                    continue
                if len(spec) > 1 and spec[0] == "type" and spec[1] != "as":
                    spec = spec[1:]
                if spec:
                    names.append((spec[-1], spec[0]))
                spec = []
            k = end + 1
        else:
            if ts[k][0] == "name":
                names.append((ts[k][1], ts[k][1]))
            k += 1
    if k < len(ts) and ts[k][1] == "from":
        k += 1
        if k < len(ts) and ts[k][0] == "string":
            out.imports += [(a, b, ts[k][1][1:-1], line) for a, b in names]
            k += 1
    return k


def extract(text: str, path: str) -> Extract:
    """Symbols, calls within symbols and imports. Other languages give nothing; text that cannot be read gives what was found before, and `failed`."""
    out = Extract()
    if path.lower().endswith(GRAPH_EXTENSIONS):
        try:
            _scan(_tokens(text), out)
        except (IndexError, AttributeError, RecursionError):
            out.failed = True
    return out


def _scan(ts: list[tuple[str, str, int]], out: Extract) -> None:
    scopes: list[tuple[int, str, str]] = []  # depth that ends it, name, kind
    pending: tuple[str, str] | None = None  # a declaration whose body has not begun
    flat: list[tuple[int, str]] = []  # arrow bodies without braces: bracket level, name
    depth = level = i = 0
    owner = lambda: flat[-1][1] if flat else next((n for _, n, _ in reversed(scopes)), None)
    while i < len(ts):
        kind, v, line = ts[i]
        before = ts[i - 1][1] if i else ""
        after = ts[i + 1][1] if i + 1 < len(ts) else ""
        if v == "{":
            depth += 1
            if pending:
                scopes.append((depth, *pending))
                pending = None
        elif v == "}":
            while scopes and scopes[-1][0] >= depth:
                scopes.pop()
            depth -= 1
        if v in ("(", "[", "{"):
            level += 1
        elif v in (")", "]", "}"):
            level -= 1
        while flat and (level < flat[-1][0] or v in (";", ",") and level == flat[-1][0]):
            flat.pop()
        if kind == "name" and before != ".":
            named = i + 1 < len(ts) and ts[i + 1][0] == "name"
            if v == "import" and depth == 0:
                i = _imports(ts, i, out)
                continue
            if v in ("function", "class", "interface", "enum", "type") and before != "?.":
                k = i + 1
                if v == "function" and after == "*":
                    k, named = i + 2, i + 2 < len(ts) and ts[i + 2][0] == "name"
                ends = ts[k + 1][1] if k + 1 < len(ts) else ""
                if named and not (v == "type" and ends not in ("=", "<")):
                    out.symbols.append((ts[k][1], v, line))
                    if v in ("function", "class"):
                        pending = (ts[k][1], v)
                    i = k + 1
                    continue
            if before in ("const", "let", "var"):
                k = i + 1
                if after == ":":  # a declared type
                    d = 0
                    while k < len(ts) and not (ts[k][1] == "=" and d == 0) and ts[k][1] != ";":
                        d += (ts[k][1] in ("(", "[", "{", "<")) - (ts[k][1] in (")", "]", "}", ">"))
                        k += 1
                if k < len(ts) and ts[k][1] == "=" and _is_arrow(ts, k + 1):
                    out.symbols.append((v, "function", line))
                    j = k + 1
                    while j < len(ts) and ts[j][1] not in ("=>", "function"):
                        j = _close(ts, j, "(", ")") + 1 if ts[j][1] == "(" else j + 1
                    if ts[min(j, len(ts) - 1)][1] == "=>" and (j + 1 >= len(ts) or ts[j + 1][1] != "{"):
                        flat.append((level, v))
                    else:
                        pending = (v, "function")
                    i = k + 1
                    continue
            in_class = bool(scopes) and scopes[-1][2] == "class" and scopes[-1][0] == depth and level == depth
            opens = i + 1
            if after == "<":
                opens = _close(ts, i + 1, "<", ">") + 1
            called = opens < len(ts) and ts[opens][1] == "("
            if in_class and called and v not in _KEYWORDS:
                end = _close(ts, opens, "(", ")")
                k = end + 1
                while k < len(ts) and ts[k][1] not in ("{", ";", "}"):
                    k += 1
                if k < len(ts) and ts[k][1] == "{":
                    out.symbols.append((v, "method", line))
                    pending = (v, "method")
                    i = opens
                    continue
        if kind == "name" and v not in _KEYWORDS:
            opens = i + 1
            if after == "?." and i + 2 < len(ts) and ts[i + 2][1] == "(":
                opens = i + 2
            if opens < len(ts) and ts[opens][1] == "(" and before not in ("new", "function", "*") and owner():
                out.calls.append((owner(), v, line))
        i += 1


def extract_all(df: DataFrame, key_cols: list[str], path_col: str, text_col: str) -> DataFrame:
    """(keys, record, name, kind, other, line): record symbol (name, kind), call (name is the caller, other the callee) import (local name, exported name as other, kind the module), or failed, where the text could not be read to its end."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key_cols) + ", record string, name string, kind string, other string, line int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, path, text in zip(zip(*(b[k] for k in key_cols)), b[path_col], b[text_col]):
                got = extract(text or "", path or "")
                rows += [(*key, "failed", None, None, None, None)] if got.failed else []
                rows += [(*key, "symbol", n, k, None, ln) for n, k, ln in got.symbols]
                rows += [(*key, "call", a, None, c, ln) for a, c, ln in got.calls]
                rows += [(*key, "import", a, m, e, ln) for a, e, m, ln in got.imports]
            yield pd.DataFrame(rows, columns=[*key_cols, "record", "name", "kind", "other", "line"])

    cols = list(dict.fromkeys([*key_cols, path_col, text_col]))
    return df.select(*cols).mapInPandas(run, schema)
