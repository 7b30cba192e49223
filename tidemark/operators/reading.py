"""Reading a source file in one fold over its tokens, inside its row.

A file is cut into tokens by one regular expression, and one ``aggregate`` walks over them with a stack of
brackets in its state.  Each bracket is a frame (what kind of bracket, whose call), each comma or statement
separated part of a frame a segment (its first tokens, its last assignment).  String literals and segments
come out as arrays of the row; there is no token table and nothing is shuffled.

A parenthesis that only groups is looked through: its frame carries the context that it stands in, so
``model: (x || "m")`` reads like ``model: x || "m"``.

The expression is SQL text because it needs names for intermediate values; ``_let`` gives them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = ["repo", "path"]

# Loops are possessive and unrolled: Java would recurse once per character.
_DQ = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SQ = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_WORD = r"[A-Za-z_$][\w$]*+|\d[\w.]*+"
# A template with the expressions inside it: braces two deep, with strings and plain templates in them.
_PLAIN_BT = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
_HOLE = rf"\$\{{(?:[^{{}}`\"']|{_DQ}|{_SQ}|{_PLAIN_BT}|\{{(?:[^{{}}`\"']|{_DQ}|{_SQ}|{_PLAIN_BT})*+\}})*+\}}"
_TEMPLATE = rf"`(?:[^`\\$]|\\(?s:.)|{_HOLE}|\$(?!\{{))*+`"
# A slash where a value is due begins a regular expression, whose quotes are no strings.
_DUE = (
    r"[=(,:\[!&|?{;+\-*%~^]|=>|(?<![\w$.])(?:return|throw|case|typeof|void|delete|in|of|do|else|await|yield|new)"
    r"|(?<![\w$.])(?:if|while|for|with) {0,4}\([^()\n]{0,200}\)"
)
_REGEX = rf"/(?![*/])(?<=(?:{_DUE})\s{{0,40}}/)[^/\\\n\[]*+(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+)*+\])[^/\\\n\[]*+)*+/[a-z]*+"
TS_GAP = r"(?:\s|//[^\n]*+|/\*(?s:.*?)\*/)*+"
TS_TOKEN = rf"{_REGEX}|{_DQ}|{_SQ}|{_TEMPLATE}|{_PLAIN_BT}|{_WORD}|=>|===|!==|==|!=|\?\?|\?\.|\|\||&&|\.\.\.|[^\s\w]"
PY_GAP = r"(?:[ \t\r\f]|\\\n|#[^\n]*+)*+"
# Blank and comment lines belong to the line break before them.
PY_TOKEN = (
    r'"""(?s:.*?)"""|' + r"'''(?s:.*?)'''" + rf"|{_DQ}|{_SQ}|{_WORD}"
    r"|\n(?:[ \t\r\f]*+(?:#[^\n]*+)?\n)*+|==|!=|<=|>=|->|:=|\*\*|[^\s\w]|\v"
)
_NOT_OPERANDS = (
    "if", "for", "while", "switch", "catch", "return", "typeof", "await", "in", "of", "not",
    "and", "or", "is", "else", "elif", "yield", "lambda",
)
_LITERAL_BRACE = ("(", ",", "=", ":", "[", "?", "||", "??", "return", "&&")
_PASSING = ("=", ":", "||", "??", "?", "(", ",", "[", "{", "or", "else")
_TS_COMPARES = ("==", "===", "!=", "!==")
_PY_COMPARES = ("==", "!=", "<", ">", "<=", ">=", "in", "is", "not")
# A literal that one of these follows is part of a larger value.
_TS_GOES_ON = ("+", "-", "*", "/", "%", ".", "?.", "[", "(", "!", "?", "&&", "<", ">", "&", "|", "satisfies", "instanceof", "in")
_PY_GOES_ON = ("+", "-", "*", "/", "%", ".", "[", "(", "and", "&", "|", "for")
_MODIFIERS = ("readonly", "static", "private", "public", "protected", "override", "declare", "{", ";", "}")
#: Tokens of a stretch, and stretches of a block.  Spark copies the state of a fold at every step, so what has
#: been found leaves the inner state after each stretch and the middle one after each block.
STRETCH = 64

TOKEN = "struct<tok: string, start: int, end: int, line: int, col: int>"
CONTEXT = "struct<role: string, callee: string, before: string, key: string, second: string, eq_name: string, eq_left: string, in_class: boolean, in_call: boolean>"
FRAME = f"struct<role: string, callee: string, before: string, in_class: boolean, in_call: boolean, start: int, deep: int, ctx: {CONTEXT}>"
SEGMENT = (
    "struct<nth: int, first: string, second: string, eq_name: string, eq_left: string, c_name: string, c_left: string, angle: int, "
    f"n: int, written: string, t1: {TOKEN}, t2: {TOKEN}, t3: {TOKEN}>"
)
LITERAL = (
    "struct<tok: string, start: int, end: int, line: int, col: int, enclosure: string, encl_name: string, in_call: boolean, "
    "callee: string, behind: string, direct: boolean, eq_name: string, eq_left: string>"
)
PART = f"struct<obj_id: int, role: string, callee: string, in_call: boolean, t1: {TOKEN}, t2: {TOKEN}, t3: {TOKEN}, n: int, stop: int, written: string>"


def _quoted(names: Iterable[str]) -> str:
    return ", ".join("'" + n + "'" for n in names)


_names = count()


def _named(name: str, value: str, body: str) -> str:
    """The body with the value under a name: a fold over nothing whose last step is the body; copies nothing."""
    n = next(_names)
    return f"aggregate(CAST(array() AS array<int>), {value}, (z{n}, e{n}) -> z{n}, {name} -> {body})"


def _let(value: str, body) -> str:
    name = f"v{next(_names)}"
    return _named(name, value, body(name))


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _among(what: str, names: Iterable[str]) -> str:
    return f"coalesce({what} IN ({_quoted(names)}), false)"


def _is_word(what: str) -> str:
    return f"coalesce({what} RLIKE '^[A-Za-z_$]', false)"


def _is_string(what: str) -> str:
    return f"coalesce(substr({what}, 1, 1) IN ('\"', '\\'', '`'), false)"


def _breaks(what: str) -> str:
    return f"(length({what}) - length(replace({what}, '\\n', '')))"


def _content(tok: str) -> str:
    width = f"(CASE WHEN {tok} RLIKE '^(\"\"\"|\\'\\'\\')' THEN 3 ELSE 1 END)"
    return f"substr({tok}, {width} + 1, length({tok}) - 2 * {width})"


EMPTY_SEGMENT = f"CAST({_struct(nth='0', first='NULL', second='NULL', eq_name='NULL', eq_left='NULL', c_name='NULL', c_left='NULL', angle='0', n='0', written=repr(''), t1='NULL', t2='NULL', t3='NULL')} AS {SEGMENT})"
_TOP = f"CAST({_struct(role=repr('top'), callee='NULL', before='NULL', in_class='false', in_call='false', start='0', deep='0', ctx='NULL')} AS {FRAME})"
_NO_LITERAL, _NO_PARTS = f"CAST(NULL AS {LITERAL})", f"CAST(array() AS array<{PART}>)"


def _initial() -> str:
    return _struct(
        i="0", pos="0", line="1", ls="0", p1="CAST(NULL AS string)", p2="CAST(NULL AS string)", p_end="0", f=_TOP, seg=EMPTY_SEGMENT,
        stack=f"CAST(array() AS array<struct<f: {FRAME}, seg: {SEGMENT}>>)", lit=_NO_LITERAL, parts=_NO_PARTS,
    )


def _context(f: str, seg: str) -> str:
    """What a value in this frame and segment is read as; a grouping parenthesis hands on what it stands in."""
    own = _struct(
        role=f"{f}.role", callee=f"{f}.callee", before=f"{f}.before", key=f"{seg}.first", second=f"{seg}.second", eq_name=f"{seg}.eq_name",
        eq_left=f"{seg}.eq_left", in_class=f"{f}.in_class", in_call=f"{f}.in_call",
    )
    return f"CASE WHEN {f}.role = 'group' THEN {f}.ctx ELSE CAST({own} AS {CONTEXT}) END"


def _part(s: str, stop: str) -> str:
    names = {c: f"{s}.seg.{c}" for c in ("t1", "t2", "t3", "n")}
    return _struct(
        obj_id=f"{s}.f.start", role=f"{s}.f.role", callee=f"{s}.f.callee", in_call=f"{s}.f.in_call", **names, stop=stop, written=f"{s}.seg.written"
    )


def _with(s: str, **changed: str) -> str:
    fields = ("i", "pos", "line", "ls", "p1", "p2", "p_end", "f", "seg", "stack", "lit", "parts")
    return _struct(**{k: changed.get(k, f"{s}.{k}") for k in fields})


def _member(s: str, t: str, a: str) -> str:
    """The state after the token has become a member of its segment."""
    ends = f"({t} = ';' OR {t} = ',' OR substr({t}, 1, 1) = '\\n')"
    seg = f"{s}.seg"
    here = _struct(tok=t, start=f"{a}.start", end=f"{a}.end", line=f"{a}.line", col=f"{a}.col")
    body = f"{t} <> ','"

    def grown(old: str) -> str:
        nth = f"({old}.nth + 1)"
        # A type runs from the colon behind a name to the assignment; its commas separate nothing.
        # The first colon of a part may be followed by a type: behind the first name (py), or anywhere (ts).
        names = f"({t} = ':' AND {old}.c_name IS NULL AND {old}.eq_name IS NULL AND ((NOT py) OR ({old}.nth = 1 AND {_is_word(f'{s}.p1')} AND {s}.p1 NOT IN ('else', 'try', 'finally'))))"
        assigns = f"{t} = '='"
        at = lambda k: f"CASE WHEN {nth} = {k} THEN {here} ELSE {old}.t{k} END"
        return "CAST(" + _struct(
            nth=nth, first=f"coalesce({old}.first, {t})", second=f"CASE WHEN {nth} = 2 THEN {t} ELSE {old}.second END",
            eq_name=f"CASE WHEN {assigns} THEN coalesce({old}.c_name, {s}.p1) ELSE {old}.eq_name END",
            eq_left=f"CASE WHEN {assigns} THEN CASE WHEN {old}.c_name IS NULL THEN {s}.p2 ELSE {old}.c_left END ELSE {old}.eq_left END",
            c_name=f"CASE WHEN {names} THEN {s}.p1 WHEN {assigns} THEN NULL ELSE {old}.c_name END",
            c_left=f"CASE WHEN {names} THEN {s}.p2 ELSE {old}.c_left END",
            angle=f"CASE WHEN {old}.c_name IS NULL OR py THEN 0 WHEN {t} = '<' THEN {old}.angle + 1 WHEN {t} = '>' THEN greatest({old}.angle - 1, 0) ELSE {old}.angle END",
            n=f"{old}.n + CAST({body} AS int)", written=f"CASE WHEN {body} THEN concat({old}.written, {t}) ELSE {old}.written END",
            t1=at(1), t2=at(2), t3=at(3),
        ) + f" AS {SEGMENT})"

    base = f"CASE WHEN {t} IN ('const', 'let', 'var', 'return') THEN {EMPTY_SEGMENT} ELSE {seg} END"
    # What the token before it has found is gone; a bracket that it closes has left its last part.
    fresh = dict(lit=_NO_LITERAL, parts=f"CASE WHEN {a}.closes THEN {s}.parts ELSE {_NO_PARTS} END")
    moved = dict(i=f"{s}.i + 1", pos=f"{a}.end", line=f"{a}.line_after", ls=f"{a}.ls_after", p1=t, p2=f"{s}.p1", p_end=f"{a}.end", **fresh)
    added = _let(base, lambda old: _let(grown(old), lambda new: _with(s, **moved, seg=new)))
    # A separator closes the segment that it ends; parts of calls and objects are kept.
    closing = _let(added, lambda m: _with(
        m, seg=EMPTY_SEGMENT,
        parts=f"CASE WHEN {m}.f.role IN ('call', 'object') THEN concat({m}.parts, array({_part(m, f'{a}.end + {a}.blanks')})) ELSE {m}.parts END",
    ))
    return f"CASE WHEN {ends} AND ({t} <> ',' OR {seg}.angle = 0) THEN {closing} ELSE {added} END"


def _closed(s: str, a: str) -> str:
    """The state with the innermost frame left; its last part ends where blanks after its last token end."""
    stop = f"{s}.p_end + length(regexp_extract({a}.gap, '^[ \\t]*', 0))"
    outer = f"get({s}.stack, size({s}.stack) - 1)"
    parts = f"CASE WHEN {s}.f.role IN ('call', 'object') AND {s}.seg.nth > 0 THEN array({_part(s, stop)}) ELSE {_NO_PARTS} END"
    popped = _with(s, f=f"{outer}.f", seg=f"{outer}.seg", stack=f"slice({s}.stack, 1, size({s}.stack) - 1)", parts=parts)
    return f"CASE WHEN size({s}.stack) > 0 THEN {popped} ELSE {_with(s, parts=_NO_PARTS)} END"


def _opened(s: str, m: str, t: str, a: str) -> str:
    """The state inside a new frame; ``s`` as before the bracket, ``m`` with the bracket as a member."""
    p1, p2 = f"{s}.p1", f"{s}.p2"
    operand = f"(({_is_word(p1)} AND {p1} NOT IN ({_quoted(_NOT_OPERANDS)})) OR {_among(p1, (')', ']', '?.'))} OR (NOT py AND {a}.adjacent AND coalesce({p1} = '>', false)))"
    role = (
        f"CASE WHEN {t} = '(' AND {operand} AND py AND coalesce({p2} = 'def', false) THEN 'params' WHEN {t} = '(' AND {operand} THEN 'call' WHEN {t} = '(' THEN 'group' "
        f"WHEN {t} = '[' AND {operand} THEN 'index' WHEN {t} = '[' THEN 'array' WHEN py OR {_among(p1, _LITERAL_BRACE)} THEN 'object' ELSE 'block' END"
    )
    around = _context(f"{s}.f", f"{m}.seg")
    passes = _among(p1, _PASSING)

    def frame(r: str, c: str) -> str:
        return f"CAST({_struct(role=r, callee=f'CASE WHEN {r} = {chr(39)}call{chr(39)} AND {_is_word(p1)} THEN {p1} END', before=p1, in_class=_among(p2, ('class', 'extends', 'implements')), in_call=f'{r} = {chr(39)}object{chr(39)} AND coalesce({c}.role = {chr(39)}call{chr(39)}, false) AND {passes}', start=f'{a}.start', deep=f'CASE WHEN {r} = {chr(39)}group{chr(39)} THEN {s}.f.deep + 1 ELSE 0 END', ctx=f'CASE WHEN {r} = {chr(39)}group{chr(39)} AND {passes} THEN {c} END')} AS {FRAME})"

    pushed = lambda r, c: _with(m, f=frame(r, c), seg=EMPTY_SEGMENT, stack=f"concat({m}.stack, array({_struct(f=f'{m}.f', seg=f'{m}.seg')}))")
    return _let(role, lambda r: _let(around, lambda c: pushed(r, c)))


def _literal(s: str, m: str, t: str, a: str, n1: str) -> str:
    """The state with the string literal recorded; ``s`` as before it, ``m`` with it as a member, ``n1`` the token behind it."""
    p1 = f"{s}.p1"
    f = f"{m}.f"
    # Prefixed strings and pieces of a concatenation are no values in Python.
    skip = f"py AND (({_is_word(p1)} AND {a}.adjacent) OR {_is_string(p1)} OR {_is_string(n1)})"
    template = f"NOT py AND {t} LIKE '`%' AND {t} LIKE '%${{%'"
    # The token behind the groups that close right after the literal.
    ahead = lambda n: f"transform(sequence({s}.i + 1, {s}.i + {n}), k -> coalesce(get(toks, k), ')'))"
    after = (
        f"CASE WHEN {f}.deep = 0 THEN {n1} "
        f"ELSE coalesce(get(filter({ahead(f'2 * {f}.deep + 2')}, x -> x <> ')' AND NOT (py AND substr(x, 1, 1) = '\\n')), 0), ')') END"
    )

    def record(c: str, nx: str) -> str:
        role = f"coalesce({c}.role, 'none')"
        passing = _among(p1, _PASSING)
        either = lambda names: f"({_among(p1, names)} OR {_among(n1, names)} OR {_among(nx, names)} OR ({f}.role = 'group' AND {_among(f'{f}.before', names)}))"
        in_object = f"({role} = 'object' AND coalesce({c}.second = ':', false))"
        compared = (
            f"CASE WHEN py THEN {either(_PY_COMPARES)} OR ({f}.role IN ('array', 'group', 'object') AND {_among(f'{f}.before', ('in', '==', '!='))} AND NOT {in_object}) "
            f"ELSE {either(_TS_COMPARES)} END"
        )
        goes_on = f"CASE WHEN py THEN {_among(nx, _PY_GOES_ON)} ELSE {_among(nx, _TS_GOES_ON)} END"
        assigned = f"{c}.eq_name IS NOT NULL"
        enclosure = (
            f"CASE WHEN {template} THEN 'template' WHEN {f}.role = 'object' AND {n1} = ':' AND {_among(p1, ('{', ','))} THEN 'property_key' WHEN {compared} THEN 'comparison' "
            f"WHEN NOT {passing} OR {goes_on} THEN 'other' "
            f"WHEN {in_object} THEN 'property_value' WHEN {role} = 'array' THEN 'array_element' WHEN py AND {role} = 'object' THEN 'array_element' "
            f"WHEN py AND {f}.role = 'group' AND ({p1} = ',' OR coalesce({n1} = ',', false)) THEN 'array_element' "
            f"WHEN {role} = 'params' AND {assigned} THEN 'param_default' WHEN py AND {role} = 'call' AND {assigned} THEN 'kwarg' WHEN {role} = 'call' THEN 'call_arg' "
            f"WHEN py AND {role} = 'top' AND {assigned} THEN 'variable' "
            f"WHEN NOT py AND {assigned} AND {_among(f'{c}.eq_left', ('const', 'let', 'var'))} THEN 'variable' "
            f"WHEN NOT py AND {assigned} AND {c}.in_class AND {_among(f'{c}.eq_left', _MODIFIERS)} THEN 'class_property' ELSE 'other' END"
        )
        key = f"CASE WHEN {_is_string(f'{c}.key')} THEN {_content(f'{c}.key')} WHEN NOT py THEN {c}.key END"
        named = lambda e: (
            f"CASE {e} WHEN 'property_value' THEN {key} WHEN 'param_default' THEN {c}.key WHEN 'variable' THEN {c}.eq_name "
            f"WHEN 'class_property' THEN {c}.eq_name WHEN 'kwarg' THEN {c}.eq_name END"
        )
        # Types are read off the tokens that follow ``as``; one of more tokens than that is not plain either way.
        behind = f"CASE WHEN NOT py AND ({n1} = 'as' OR {nx} = 'as') THEN array_join({ahead(f'64 + {f}.deep')}, ' ') END"
        made = lambda e: f"CAST({_struct(tok=t, start=f'{a}.start', end=f'{a}.end', line=f'{a}.line', col=f'{a}.col', enclosure=e, encl_name=named(e), in_call=f'CASE WHEN {e} = {chr(39)}property_value{chr(39)} THEN coalesce({c}.in_call, false) END', callee=f'CASE WHEN {e} = {chr(39)}call_arg{chr(39)} THEN {c}.callee END', behind=behind, direct=f'coalesce({p1} = {chr(39)}={chr(39)}, false)', eq_name=f'{c}.eq_name', eq_left=f'{c}.eq_left')} AS {LITERAL})"
        return _with(m, lit=_let(enclosure, made))

    found = _let(_context(f, f"{m}.seg"), lambda c: _let(after, lambda nx: record(c, nx)))
    return f"CASE WHEN {skip} THEN {m} ELSE {found} END"


def _step(s: str, t: str) -> str:
    inner = f"size({s}.stack) > 0"
    ahead = f"CASE WHEN py AND {inner} AND substr(get(toks, {s}.i + 1), 1, 1) = '\\n' THEN get(toks, {s}.i + 2) ELSE get(toks, {s}.i + 1) END"

    def about(gap: str, start: str) -> str:
        end = f"({start} + length({t}))"
        lines = (
            f"CASE WHEN instr({gap}, '\\n') > 0 THEN {_struct(line=f'{s}.line + {_breaks(gap)}', ls=f'{start} - length(substring_index({gap}, {chr(39)}{chr(92)}n{chr(39)}, -1))')} "
            f"ELSE {_struct(line=f'{s}.line', ls=f'{s}.ls')} END"
        )
        return _let(lines, lambda at: _struct(
            gap=gap, start=start, end=end, line=f"{at}.line", col=f"{start} - {at}.ls + 1",
            line_after=f"CASE WHEN instr({t}, '\\n') > 0 THEN {at}.line + {_breaks(t)} ELSE {at}.line END",
            ls_after=f"CASE WHEN instr({t}, '\\n') > 0 THEN {end} - length(substring_index({t}, '\\n', -1)) ELSE {at}.ls END",
            closes=f"{t} IN (')', ']', '}}')", adjacent=f"{start} = {s}.p_end", blanks=f"CASE WHEN {t} = ',' OR {t} = ';' OR substr({t}, 1, 1) = '\\n' THEN length(regexp_extract(coalesce(get(gaps, {s}.i + 1), ''), '^[ \\t]*', 0)) END",
        ))

    def read(a: str) -> str:
        skipped = _with(s, i=f"{s}.i + 1", pos=f"{a}.end", line=f"{a}.line_after", ls=f"{a}.ls_after", lit=_NO_LITERAL, parts=_NO_PARTS)
        # The member stands in the expression once: every task prepares the whole of it anew.
        closed = f"CASE WHEN {a}.closes THEN {_closed(s, a)} ELSE {s} END"
        literal = lambda m: _let(ahead, lambda n1: _literal(s, m, t, a, n1))
        entered = lambda m: f"CASE WHEN {t} IN ('(', '[', '{{') THEN {_opened(s, m, t, a)} WHEN {_is_string(t)} THEN {literal(m)} ELSE {m} END"
        member = _let(closed, lambda o: _let(_member(o, t, a), entered))
        return f"CASE WHEN py AND {inner} AND substr({t}, 1, 1) = '\\n' THEN {skipped} ELSE {member} END"

    return _let(f"get(gaps, {s}.i)", lambda gap: _let(f"{s}.pos + length({gap})", lambda start: _let(about(gap, start), read)))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fold(result: str) -> str:
    """The reading of ``toks`` and ``gaps``: a fold over blocks of folds over stretches of folds over tokens."""
    empty = lambda of, deep: f"CAST(array() AS {'array<' * deep}{of}{'>' * deep})"
    state = lambda core, deep: _struct(core=core, lits=empty(LITERAL, deep), parts=empty(PART, deep))

    def token(s: str, i: str) -> str:
        return _let(f"get(toks, {i})", lambda t: _let(_step(f"{s}.core", t), lambda r: _struct(
            core=r, lits=f"CASE WHEN {r}.lit IS NULL THEN {s}.lits ELSE concat({s}.lits, array({r}.lit)) END",
            parts=f"CASE WHEN size({r}.parts) = 0 THEN {s}.parts ELSE concat({s}.parts, {r}.parts) END",
        )))

    def gathered(s: str, found: str) -> str:
        return _let(found, lambda r: _struct(core=f"{r}.core", lits=f"concat({s}.lits, array({r}.lits))", parts=f"concat({s}.parts, array({r}.parts))"))

    places = lambda first, size, step: f"filter(sequence({first}, {first} + {size} - 1, {step}), k -> k < size(toks))"
    stretch = lambda s, i: gathered(s, f"aggregate({places(i, STRETCH, 1)}, {state(f'{s}.core', 1)}, (s1, k) -> {token('s1', 'k')})")
    block = lambda s, i: gathered(s, f"aggregate({places(i, STRETCH * STRETCH, STRETCH)}, {state(f'{s}.core', 2)}, (s2, j) -> {stretch('s2', 'j')})")
    return f"aggregate({places('0', 'greatest(size(toks), 1)', STRETCH * STRETCH)}, {state(_initial(), 3)}, (s3, i) -> {block('s3', 'i')}, s -> {result})"


def _entries(of: str) -> str:
    return f"flatten(flatten({of}))"


def _inside(template: str) -> str:
    """Literals inside the expressions of a template, with their places in the file."""
    length_of = lambda parts: f"aggregate({parts}, 0, (n, x) -> n + length(x))"
    hole = _text(rf"(?<!\\){_HOLE}")
    fields = [f.split(":")[0] for f in LITERAL[len("struct<") : -1].split(", ")]

    def moved(before: str) -> str:
        line = f"({template}.line + {_breaks(before)})"
        col = f"CASE WHEN instr({before}, '\\n') > 0 THEN length(substring_index({before}, '\\n', -1)) ELSE {template}.col - 1 + length({before}) END"
        offset = f"({template}.start + length({before}))"
        changed = dict(start=f"x.start + {offset}", end=f"x.end + {offset}", line=f"{line} + x.line - 1", col=f"CASE WHEN x.line = 1 THEN x.col + {col} ELSE x.col END")
        inner = _fold(f"filter({_entries('s.lits')}, x -> x.enclosure <> 'template')")
        body = "substr(h, 3, length(h) - 3)"
        cut = lambda group: f"regexp_extract_all({body}, {_text(f'({TS_GAP})({TS_TOKEN})')}, {group})"
        read = _named("toks", cut(2), _named("gaps", cut(1), inner))
        return f"transform({read}, x -> {_struct(**{k: changed.get(k, f'x.{k}') for k in fields})})"

    at = "substr({0}.tok, 1, 2 + " + length_of("slice(ps, 1, k + 1)") + " + " + length_of("slice(hs, 1, k)") + ")"
    each = f"flatten(transform(hs, (h, k) -> {_let(at.format(template), moved)}))"
    return _named("hs", f"regexp_extract_all({template}.tok, {hole}, 0)", _named("ps", f"split({template}.tok, {hole})", each))


def facts(files: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """(repo, path, lang, lits, parts): literals and parts of calls and object literals of every file.

    ``keys`` name the rows, if they are not files.

    Literals inside the expressions of a template are read by the same fold over the expression.
    """
    py = F.col("lang") == "py"

    def pieces(group: int) -> Column:
        cut = lambda gap, tok: F.regexp_extract_all("text", F.lit(f"({gap})({tok})"), F.lit(group))
        return F.when(py, cut(PY_GAP, PY_TOKEN)).otherwise(cut(TS_GAP, TS_TOKEN))

    read = files.where(F.col("lang").isin("ts", "py")).select(*keys, "lang", py.alias("py"), pieces(1).alias("gaps"), pieces(2).alias("toks"))
    found = read.select(*keys, "lang", "py", F.expr(_fold(_struct(lits=_entries("s.lits"), parts=_entries("s.parts")))).alias("found"))
    plain = "filter(found.lits, l -> l.enclosure <> 'template')"
    inner = f"flatten(transform(filter(found.lits, l -> l.enclosure = 'template'), l -> {_inside('l')}))"
    return found.select(*keys, "lang", F.expr(f"concat({plain}, {inner})").alias("lits"), F.col("found.parts").alias("parts"))
