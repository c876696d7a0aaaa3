"""A static look at the Python code in an answer: parsed into a syntax tree, never run."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCED = re.compile(r"```(?:python|py)?[ \t]*\n(.*?)```", re.DOTALL | re.IGNORECASE)


def blocks(answer: str) -> list[str]:
    """The code blocks of an answer, or the whole of it where it has none."""
    return _FENCED.findall(answer) or [answer]


def _parsed(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _ends(statement: ast.stmt) -> bool:
    """Whether nothing behind the statement in its block can be reached."""
    if isinstance(statement, (ast.Return, ast.Raise, ast.Continue, ast.Break)):
        return True
    return isinstance(statement, ast.If) and bool(statement.orelse) and all(any(map(_ends, body)) for body in (statement.body, statement.orelse))


def answers(body: Sequence[ast.stmt]) -> bool:
    """Whether a value can be returned or yielded from statements, functions and classes within them aside."""
    for statement in body:
        if isinstance(statement, ast.Return):
            return statement.value is not None
        if isinstance(statement, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        parts = [getattr(statement, name, []) for name in ("body", "orelse", "finalbody")] + [h.body for h in getattr(statement, "handlers", [])] + [c.body for c in getattr(statement, "cases", [])]
        if any(answers(p) for p in parts if p):
            return True
        own = [x for x in ast.iter_child_nodes(statement) if isinstance(x, ast.expr)]
        if any(isinstance(x, (ast.Yield, ast.YieldFrom)) for e in own for x in ast.walk(e)):
            return True
        if _ends(statement):
            return False
    return False


def takes(function: ast.FunctionDef | ast.AsyncFunctionDef, count: int) -> bool:
    """Whether a function can be called with so many positional arguments."""
    given = function.args
    positional = len(given.posonlyargs) + len(given.args)
    if any(d is None for d in given.kw_defaults):
        return False
    return positional - len(given.defaults) <= count and (given.vararg is not None or count <= positional)


def defines(source: str, entry: str, counts: Sequence[int] = ()) -> bool | None:
    """Whether code defines the function `entry` at its top level, which takes the arguments asked for and returns something; null if it doesn't name it at all."""
    tree = _parsed(source)
    if tree is None:
        return False if re.search(rf"\b{re.escape(entry)}\b", source) else None
    # The last definition is the one that a call meets.
    found = [s for s in tree.body if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) and s.name == entry]
    if not found:
        return None
    return answers(found[-1].body) and all(takes(found[-1], n) for n in counts)


def check(answer: str, entry: str, counts: Sequence[int] = ()) -> bool:
    """By the first block that defines the function; a block that names it but doesn't parse is no definition."""
    told = [defines(b, entry, counts) for b in blocks(answer)]
    return next((t for t in told if t is not None), False)


def defines_function(answer: Column, entry: str, counts: Sequence[int] = ()) -> Column:
    """check over a column; only answers that hold the name go to Python."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and check(t, entry, counts)).astype(bool)

    holds = F.contains(answer, F.lit(entry))
    return holds & run(F.when(holds, answer))
