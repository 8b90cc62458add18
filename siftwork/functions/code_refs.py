"""The names that a piece of Python refers to, from its syntax tree; from its calls alone where it does not parse."""

from __future__ import annotations

import ast
import keyword
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa

# --- fixed values: weights of kinds of reference ---
WEIGHTS = {"call": 1.0, "attribute": 1.0, "import": 1.0, "annotation": 0.7, "decorator": 1.0}
_KINDS = (ast.Call, ast.Attribute, ast.Import, ast.ImportFrom, ast.AnnAssign, ast.FunctionDef, ast.AsyncFunctionDef)
_CALL = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(")
#: A name, or a whole number that no letter, digit or full stop touches.
_TOKEN = re.compile(r"((?<![0-9A-Za-z_])[A-Za-z_][A-Za-z0-9_]*|(?<![0-9A-Za-z_.])[1-9][0-9]{0,17}(?![0-9A-Za-z_.]))")
#: Words that the grammar knows, and shapes that are remembered at once.
_FIXED, SHAPES = {*keyword.kwlist, *keyword.softkwlist}, 1000


def _last(node: ast.AST | None) -> str | None:
    """The rightmost name of an expression."""
    match node:
        case ast.Name(id=name) | ast.Attribute(attr=name):
            return name
        case ast.Subscript(value=inner) | ast.Call(func=inner):
            return _last(inner)
    return None


def _of(node: ast.AST) -> Iterator[tuple[str | None, str, int]]:
    line = getattr(node, "lineno", 0)
    match node:
        case ast.Call(func=f):
            yield _last(f), "call", line
        case ast.Attribute(attr=name):
            yield name, "attribute", line
        case ast.Import(names=names):
            yield from ((a.name.partition(".")[0], "import", line) for a in names)
        case ast.ImportFrom(module=module, names=names):
            yield module and module.partition(".")[0], "import", line
            yield from ((a.name, "import", line) for a in names if a.name != "*")
        case ast.AnnAssign(annotation=kind):
            yield _last(kind), "annotation", line
        case ast.FunctionDef() | ast.AsyncFunctionDef():
            yield from ((_last(d), "decorator", d.lineno) for d in node.decorator_list)
            yield _last(node.returns), "annotation", line
            yield from ((_last(a.annotation), "annotation", line) for a in node.args.args)


def _walk(tree: ast.AST) -> Iterator[ast.AST]:
    """Those nodes, among all of a tree, that refer to something."""
    todo = [tree]
    for node in todo:
        if isinstance(node, _KINDS):
            yield node
        for field in node._fields:
            value = getattr(node, field, None)
            if isinstance(value, list):
                todo += [x for x in value if isinstance(x, ast.AST)]
            elif isinstance(value, ast.AST):
                todo.append(value)


def references(source: str) -> list[tuple[str, str, int]]:
    """(name, kind, line) of every reference, repeats included."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        return [r for node in _walk(tree) for r in _of(node) if r[0]]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(m[1], "call", n) for n, line in enumerate(source.split("\n"), 1) for m in _CALL.finditer(line) if m[1] not in keyword.kwlist]


def shape(source: str) -> tuple[tuple | None, list[str]]:
    """A source with its names numbered and whole numbers as one, and the names; no shape for one whose tokens are not plain to see.

    Two sources of one shape differ in names and numbers alone, and equal names stay equal, so their trees are the
    same but for those: sources with quotes, backslashes, characters other than ASCII or __debug__ have no shape.
    """
    if not source.isascii() or any(c in source for c in "'\"`\\\0") or "__debug__" in source:
        return None, []
    parts = _TOKEN.split(source)
    numbers: dict[str, int] = {}
    for i in range(1, len(parts), 2):
        t = parts[i]
        if t[0].isdigit():
            parts[i] = "1"
        elif t not in _FIXED:
            parts[i] = numbers.setdefault(t, len(numbers))
    return tuple(parts), list(numbers)


def ref_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, text) to rows (key, name, kind, line); sources of one shape are parsed once, as long as it is remembered."""
    known: dict[tuple, list] = {}
    for batch in batches:
        owner, names, kinds, lines = [], [], [], []
        for at, source in enumerate(batch.column(1).to_pylist()):
            form, own = shape(source or "")
            rows = known.get(form) if form else None
            if rows is None:
                place = {n: i for i, n in enumerate(own)}
                rows = [(place.get(n), n, k, line) for n, k, line in references(source or "")]
                if form and len(form) < 10_000:
                    if len(known) >= SHAPES:
                        known.pop(next(iter(known)))
                    known[form] = rows
            for i, name, kind, line in rows:
                owner.append(at)
                names.append(name if i is None else own[i])
                kinds.append(kind)
                lines.append(line)
        key = batch.column(0).take(pa.array(owner, pa.int64()))
        yield pa.RecordBatch.from_arrays([key, pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(lines, pa.int32())], names=["key", "name", "kind", "line"])
