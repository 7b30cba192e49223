"""Reader of one Python file, used inside Arrow tasks; built on the stdlib ``ast``."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from .. import config as C

_PLAIN = re.compile(
    r'"""((?:[^\\]|\\.)*?)"""|\'\'\'((?:[^\\]|\\.)*?)\'\'\'|"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'',
    re.S,
)
_MODEL = re.compile(C.MODEL_NAME_PATTERN)


def _line_starts(text: str) -> list[int]:
    starts = [0]
    starts.extend(i + 1 for i, ch in enumerate(text) if ch == "\n")
    return starts


class _PythonFile:
    def __init__(self, text: str):
        self.text = text
        self.tree = ast.parse(text)
        self.lines = text.split("\n")
        self.starts = _line_starts(text)
        self.parent: dict[ast.AST, ast.AST] = {}
        for node in ast.walk(self.tree):
            for child in ast.iter_child_nodes(node):
                self.parent[child] = node

    def offset(self, line: int, byte_col: int) -> int:
        row = self.lines[line - 1]
        col = byte_col if row.isascii() else len(row.encode()[:byte_col].decode())
        return self.starts[line - 1] + col

    def plain(self, node: ast.AST) -> tuple[str, int, int, str] | None:
        """(content, start, end, quote) of an unprefixed, unbroken string literal."""
        if not (isinstance(node, ast.Constant) and isinstance(node.value, str)):
            return None
        start = self.offset(node.lineno, node.col_offset)
        end = self.offset(node.end_lineno, node.end_col_offset)
        match = _PLAIN.fullmatch(self.text, start, end)
        if not match:
            return None
        group = match.lastindex
        return match.group(group), match.start(group), match.end(group), self.text[start : match.start(group)]

    def climb(self, node: ast.AST) -> tuple[ast.AST, ast.AST | None]:
        """Step over ``or`` and conditional branches, which pass a value on."""
        parent = self.parent.get(node)
        while parent is not None:
            passes = (isinstance(parent, ast.BoolOp) and isinstance(parent.op, ast.Or)) or (
                isinstance(parent, ast.IfExp) and node is not parent.test
            )
            if not passes:
                break
            node, parent = parent, self.parent.get(parent)
        return node, parent

    def dict_in_call(self, node: ast.Dict) -> bool:
        inner, parent = self.climb(node)
        if isinstance(parent, ast.keyword):
            return isinstance(self.parent.get(parent), ast.Call)
        return isinstance(parent, ast.Call) and inner in parent.args

    def enclosure(self, literal: ast.AST) -> dict:
        node, parent = self.climb(literal)
        if isinstance(parent, ast.keyword):
            return {"enclosure": "kwarg", "encl_name": parent.arg}
        if isinstance(parent, ast.Dict):
            if node in parent.keys:
                return {"enclosure": "property_key"}
            key = parent.keys[parent.values.index(node)]
            named = self.plain(key) if key is not None else None
            return {
                "enclosure": "property_value",
                "encl_name": named[0] if named else None,
                "in_call": self.dict_in_call(parent),
            }
        if isinstance(parent, ast.Assign) and node is parent.value:
            return {"enclosure": "variable", "encl_name": _traceable(parent.targets[-1])}
        if isinstance(parent, ast.AnnAssign) and node is parent.value:
            return {"enclosure": "variable", "encl_name": _traceable(parent.target)}
        if isinstance(parent, ast.arguments):
            return {"enclosure": "param_default", "encl_name": _default_name(parent, node)}
        if isinstance(parent, ast.Call) and node in parent.args:
            return {"enclosure": "call_arg", "callee": _traceable(parent.func)}
        if isinstance(parent, ast.Compare):
            return {"enclosure": "comparison"}
        if isinstance(parent, (ast.List, ast.Tuple, ast.Set)):
            above = self.parent.get(parent)
            return {"enclosure": "comparison" if isinstance(above, ast.Compare) else "array_element"}
        return {"enclosure": "other" if parent is not None else "none"}

    def sinks(self) -> set[str]:
        """Names that reach a model keyword, a model factory or a model key of a call."""
        names: set[str | None] = set()
        for node in ast.walk(self.tree):
            if isinstance(node, ast.keyword) and node.arg and _MODEL.search(node.arg):
                names.add(_traceable(node.value))
            elif isinstance(node, ast.Call) and _traceable(node.func) in C.PY_FACTORIES:
                names.update(_traceable(a) for a in node.args)
            elif isinstance(node, ast.Dict) and self.dict_in_call(node):
                for key, value in zip(node.keys, node.values):
                    named = self.plain(key) if key is not None else None
                    if named and _MODEL.search(named[0]):
                        names.add(_traceable(value))
        names.discard(None)
        return names


def _traceable(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    return node.attr if isinstance(node, ast.Attribute) else None


def _default_name(arguments: ast.arguments, default: ast.AST) -> str | None:
    positional = arguments.posonlyargs + arguments.args
    tail = positional[len(positional) - len(arguments.defaults) :]
    for arg, value in [*zip(tail, arguments.defaults), *zip(arguments.kwonlyargs, arguments.kw_defaults)]:
        if value is default:
            return arg.arg
    return None


def python_errors(text: str) -> int:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return 1
    return 0


def scan_python(text: str) -> Iterator[dict]:
    """Literal and sink facts of one Python file; a single error fact if unparsable."""
    try:
        source = _PythonFile(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield {"fact": "error"}
        return
    for node in ast.walk(source.tree):
        found = source.plain(node)
        if found is None:
            continue
        value, start, end, quote = found
        yield {
            "fact": "literal",
            "line": node.lineno,
            "col": source.offset(node.lineno, node.col_offset) - source.starts[node.lineno - 1] + 1,
            "start": start,
            "end": end,
            "quote": quote,
            "value": value,
            **source.enclosure(node),
        }
    for name in sorted(source.sinks()):
        yield {"fact": "sink", "ident": name}
