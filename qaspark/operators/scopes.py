"""Scopes of source files: classes and methods with their bodies, found in one pass that knows strings, comments and brackets.

``masked`` blanks the contents of strings and comments, places kept, so that brackets and keywords inside them count for nothing.
C-like languages take their scopes from braces, Python from indentation. ``with_scopes`` deals the files out over tasks and runs the
helper, a file a row; all that follows works on its rows with DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.functions.tables import small_batches

_QUOTED = r""""(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?"""
_C_LIKE = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|""".*?(?:"""|\Z)|R"\((?:.*?)\)"|\$?@\$?"(?:[^"]|"")*"?|' + _QUOTED, re.S)
_PYTHON = re.compile(r'#[^\n]*|"""(?:\\.|.)*?(?:"""|\Z)|' + r"'''(?:\\.|.)*?(?:'''|\Z)|" + _QUOTED, re.S)

_LINE = re.compile(r"\n([ \t]*)(?=\S)")

#: Method and class heads, on masked code. Groups: name, and return type where the language writes it before.
_HEADS = {
    "csharp": re.compile(r"\b(?:public|private|protected|internal)\s+(?:(?:static|async|virtual|override|sealed|abstract|new)\s+)*(?P<type>[\w.]+(?:<[^;{}()]*?>)?[\[\]?]*)\s+(?P<name>\w+)\s*(?:<[\w\s,]*>)?\s*\("),
    "java": re.compile(r"\b(?:public|private|protected)\s+(?:(?:static|final|synchronized|abstract)\s+)*(?:<[\w\s,?]*>\s*)?(?P<type>[\w.]+(?:<[^;{}()]*?>)?[\[\]]*)\s+(?P<name>\w+)\s*\("),
    "python": re.compile(r"^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*\(", re.M),
    "cpp": re.compile(r"^(?P<type>(?:[ \t]*(?!return\b|else\b|new\b|throw\b)[\w:<>&*,]+[ \t]+)+[&*]?)(?P<name>[\w:~]+)[ \t]*\(", re.M),
}
_CLASSES = {
    "csharp": re.compile(r"\b(?:class|struct|record|interface)\s+(?P<name>\w+)(?P<bases>[^{;]*)\{"),
    "java": re.compile(r"\b(?:class|interface|enum)\s+(?P<name>\w+)(?P<bases>[^{;]*)\{"),
    "python": re.compile(r"^(?P<indent>[ \t]*)class[ \t]+(?P<name>\w+)(?P<bases>[^\n]*?):[ \t]*$", re.M),
    "cpp": re.compile(r"\b(?:class|struct)\s+(?P<name>\w+)(?P<bases>[^{;()]*)\{"),
}


@dataclass
class Scope:
    kind: str
    name: str
    start: int
    stop: int
    owner: str = ""
    type: str = ""
    parameters: str = ""
    bases: str = ""
    body: str = ""
    code: str = ""


def masked(code: str, language: str) -> str:
    """``code`` with blanks for what strings and comments hold; quotes and line ends stay, and so does every place."""

    def blank(m: re.Match) -> str:
        t = m[0]
        quotes = t[0] not in "/#" and len(t) > 1
        return "".join(c if c == "\n" or (quotes and i in (0, len(t) - 1)) else " " for i, c in enumerate(t))

    return (_PYTHON if language == "python" else _C_LIKE).sub(blank, code)


def closers(text: str) -> dict[int, int]:
    """Place of each opening bracket in masked code -> place of its closing one; the end of the text if it has none."""
    found, open_ = {}, []
    pairs = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[(){}\[\]]", text):
        if m[0] in "([{":
            open_.append((m[0], m.start()))
        elif any(b == pairs[m[0]] for b, _ in open_[-8:]):  # a stray closing bracket closes nothing
            while True:
                bracket, at = open_.pop()
                found[at] = m.start()
                if bracket == pairs[m[0]]:
                    break
    return found | {at: len(text) for _, at in open_}


def _indented(text: str, at: int, indent: int) -> int:
    """End of the block that follows ``at``: before the first line that is indented no further than its head."""
    for m in _LINE.finditer(text, at):
        if len(m[1].expandtabs()) <= indent:
            return m.start()
    return len(text)


def _method(code: str, text: str, language: str, m: re.Match, close: dict[int, int]) -> Scope | None:
    end = close.get(m.end() - 1, len(text))
    found = Scope("method", m["name"], m.start(), end + 1, type=(m.groupdict().get("type") or "").strip(), parameters=code[m.end() : end].strip())
    if language == "python":
        head = re.compile(r"[ \t]*(?:->[ \t]*([^:\n]+))?:").match(text, end + 1)
        if not head:
            return None
        found.type = code[head.start(1) : head.end(1)].strip() if head[1] else ""
        found.stop = _indented(text, head.end(), len(m["indent"].expandtabs()))
        found.body = code[head.end() : found.stop].strip("\n").rstrip()
        return found
    nxt = re.compile(r"[^{;=]*(?:\{|;|=>|=|\Z)").match(text, end + 1)
    last = nxt[0][-1:] if nxt else ""
    if last == "{":
        at = nxt.end() - 1
        found.stop = close[at] + 1
        found.body = code[at : found.stop]
    elif nxt and nxt[0].endswith("=>"):
        stop = text.find(";", nxt.end())
        found.stop = len(text) if stop < 0 else stop + 1
        found.body = code[nxt.end() : found.stop].strip()
    elif language == "cpp":
        return None  # a call or a declaration
    return found


def scopes(code: str | None, language: str | None) -> list[Scope]:
    """Classes and methods in order of their start; a method's owner is the innermost class around it. None for other languages."""
    if not code or language not in _HEADS:
        return []
    text = masked(code, language)
    close = closers(text)
    classes = []
    for m in _CLASSES[language].finditer(text):
        if language == "python":
            stop = _indented(text, m.end(), len(m["indent"].expandtabs()))
        else:
            stop = close.get(m.end() - 1, len(text)) + 1
        bases = code[m.start("bases") : m.end("bases")].strip().strip("():").strip()
        classes.append(Scope("class", m["name"], m.start(), stop, bases=bases, body=code[m.end() : stop], code=text[m.end() : stop]))
    methods = [x for m in _HEADS[language].finditer(text) if (x := _method(code, text, language, m, close))]
    found = sorted(classes + methods, key=lambda s: (s.start, -s.stop))
    around: list[Scope] = []
    for s in found:
        while around and around[-1].stop <= s.start:
            around.pop()
        s.owner = around[-1].name if around else ""
        if s.kind == "class":
            around.append(s)
        else:
            s.code = text[s.stop - len(s.body) : s.stop] if language != "python" else masked(s.body, language)
    return found


def chain(code: str, text: str, at: int, close: dict[int, int]) -> list[tuple[str, str]]:
    """(name, arguments) of the calls ``.Name(arguments)`` that follow one another from ``at`` on, in code and its masked text."""
    calls, call = [], re.compile(r"\s*\.\s*(\w+)\s*(?:<[^;()]*?>)?\s*\(")
    while m := call.match(text, at):
        end = close.get(m.end() - 1, len(text))
        calls.append((m[1], code[m.end() : end].strip()))
        at = end + 1
    return calls


def fluent_rules(body: str) -> list[tuple[str, str]]:
    """(property, rules) of the ``RuleFor(x => x.Property)`` chains in a class body; a rule is its name and its arguments, if any."""
    text = masked(body, "csharp")
    close, found = closers(text), []
    for m in re.finditer(r"\bRuleFor\s*\(", text):
        end = close.get(m.end() - 1, len(text))
        property_ = re.search(r"=>\s*[\w.]*?\.?(\w+)\s*$", text[m.end() : end].rstrip())
        if property_:
            calls = chain(body, text, end + 1, close)
            found.append((property_[1], ",".join(name + (f"({arguments})" if arguments else "") for name, arguments in calls)))
    return found


#: Limits of a pydantic field, in the order in which they are reported.
LIMITS = ("min_length", "max_length", "ge", "gt", "le", "lt", "regex", "pattern")


def arguments_of(code: str, text: str) -> list[str]:
    """The arguments in a call's parentheses, one by one: commas inside brackets and strings do not part them."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            parts.append(code[start:i].strip())
            start = i + 1
    return [p for p in [*parts, code[start:].strip()] if p]


def field_limits(body: str) -> list[tuple[str, str]]:
    """(field, limits) of the ``name: type = Field(...)`` lines of a class body that set any limit."""
    text = masked(body, "python")
    close, found = closers(text), []
    for m in re.finditer(r"^[ \t]*(\w+)[ \t]*:[^=\n]*=[ \t]*Field[ \t]*\(", text, re.M):
        end = close.get(m.end() - 1, len(text))
        given = dict(a.split("=", 1) for a in arguments_of(body[m.end() : end], text[m.end() : end]) if re.match(r"\w+\s*=(?!=)", a))
        given = {k.strip(): re.sub(r"^r?(['\"])(.*)\1$", r"\2", v.strip()) for k, v in given.items()}
        limits = [f"{k}({given[k]})" for k in LIMITS if k in given]
        if limits:
            found.append((m[1], ",".join(limits)))
    return found


def rules(language: str | None, scope: Scope) -> list[tuple[str, str]]:
    """(field, rules) that a class scope states: fluent rules of a C# validator, limits of a pydantic model's fields."""
    if language == "csharp" and "AbstractValidator" in scope.bases:
        return fluent_rules(scope.body)
    return field_limits(scope.body) if language == "python" else []


#: Files that are worth a task, and tasks up to which Spark deals rows out without sorting them in memory (its bypass of the merge
#: sort); characters of scopes that a task holds before it emits them.
TASK_FILES, TASKS = 5000, 200
HELD_CHARS = 4_000_000

_NAMES = ("kind", "name", "owner", "type", "parameters", "bases", "body", "code")
SCOPES = f"path string, language string, {', '.join(f'{n} string' for n in _NAMES)}, rules array<struct<field:string,rules:string>>"
_ROWS = pa.schema([(n, pa.string()) for n in ("path", "language", *_NAMES)] + [("rules", pa.list_(pa.struct([("field", pa.string()), ("rules", pa.string())])))])


def spread(files: DataFrame) -> DataFrame:
    """``files`` dealt out over as many tasks as their number needs: a table of a few megabytes comes in a task or two otherwise."""
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, min(TASKS, -(-files.count() // TASK_FILES)))
    return files.repartition(tasks, "path", F.xxhash64("code"))


def with_scopes(files: DataFrame, kind: str) -> DataFrame:
    """path, language and one row per scope of the ``kind`` (class or method): kind, name, owner, type, parameters, bases, body, code, rules.

    ``code`` is the body with strings and comments blanked. Files without scopes, null code and other languages give no rows; a file
    is read whole, and unclosed brackets end with it. Rows leave a task some megabytes at a time.
    """
    small_batches(files.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, language, code in zip(*(batch.column(i) for i in range(3)), strict=True):
                path, language = path.as_py(), language.as_py()
                for s in scopes(code.as_py(), language):
                    if s.kind == kind:
                        stated = [{"field": f, "rules": r} for f, r in rules(language, s)] if kind == "class" else []
                        rows.append({"path": path, "language": language, **{n: getattr(s, n) for n in _NAMES}, "rules": stated})
                        held += len(s.body) + len(s.code)
                        if held > HELD_CHARS:
                            yield pa.RecordBatch.from_pylist(rows, _ROWS)
                            rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ROWS)

    known = files.where(F.col("language").isin(*_HEADS)).select("path", "language", "code")
    return spread(known).mapInArrow(find, SCOPES)
