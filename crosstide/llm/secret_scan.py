"""Secret scan: base patterns, and literals that reach sensitive names.

Texts are lexed once into strings, names, brackets and assignment marks, and the
tokens are parsed as assignments of source and configuration syntax:

    name = "x"   name := x   name: x   "name": "x"   name => x   name: type = "x"
    conf["name"] = "x"   call(name="x")   define("name", "x")   export NAME=x
    <name>x</name>   attr="x"   name: | (an indented block)   quotes by three

Quoted literals may be joined by + . or juxtaposition. Names are propagated in
order and by scope of braces: a name stands for the last value given to it in a
scope that is still open, or else for the next value that it gets. Each literal
is scored by the sensitivity of every name that it reaches and by its own shape.

Lexing, parsing and propagation take time in proportion to the text: whatever a
pattern has passed without success it does not pass again.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm._common import small_batches

KINDS = ("assign", "access", "hex", "literal")

#: The base patterns and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

#: Words of a name and how sensitive they make it; pairs count for words that mean little alone.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "bearer": 0.7}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 0.9, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("auth", "key"): 0.9, ("account", "key"): 0.8, ("pass", "phrase"): 1.0}
#: Words that say a name holds something about a secret, and values that hold none.
HARMLESS_WORDS = {"name", "file", "path", "url", "uri", "length", "len", "size", "count", "type", "id", "field", "label", "policy", "expiry", "expires", "ttl", "hint", "format", "prefix"}
PLACEHOLDERS = {"changeme", "password", "passwd", "secret", "token", "example", "placeholder", "none", "null", "true", "false", "undefined", "todo", "xxx", "string", "your_password", "your_token"}

THRESHOLD = 0.75
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+(?:[.-][A-Za-z_$][A-Za-z0-9_$]*+)*+"
#: Tokens in order of preference; an escaped character outside strings is one token, so no quote is tried twice.
_TOKEN = re.compile(
    rf"""(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+''')
    |(?P<text>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)
    |(?P<name>{_NAME})|(?P<op>:=|=>|===?|[!<>]=|=|:)|(?P<mark>[()\[\]{{}},;+.|<>/\n])|(?P<other>\\.|[0-9]++[A-Za-z0-9_]*+|"|')""",
    re.X | re.S,
)
_BARE = re.compile(r"[A-Za-z0-9+/_.=$@!%^&*~-]++")
_TAG = re.compile(rf"<(?P<name>{_NAME})(?:\s[^<>]*+)?>(?P<bare>[^<>\s]++)</(?P=name)>")
_IDENTIFIER = re.compile(rf"{_NAME}\Z")
_KEY = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*\Z")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[\x20\t]*+\n")
_GAP = re.compile(r"[\x20\t]*+")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@lru_cache(4096)
def name_score(name: str) -> float:
    """0 to 1: how likely a value under this name is to be a secret."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[-1] in HARMLESS_WORDS:
        return 0.0
    score = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    for pair in zip(words, words[1:]):
        score = max(score, SENSITIVE_PAIRS.get(pair, 0.0))
    return score


def literal_score(value: str) -> float:
    """0 to 1: whether the text looks like a value that someone generated or chose as a secret."""
    if len(value) < 6 or value.lower().strip("<>*${}%_") in PLACEHOLDERS or len(set(value)) < 4:
        return 0.0
    if value.startswith(("http://", "https://", "${", "$(", "{{", "<")) or " " in value:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, 0.35 + entropy / 8 + 0.1 * kinds)


class _Value:
    """What a name stands for: places of literals, and the most sensitive name that they reach."""

    __slots__ = ("best", "found", "same")

    def __init__(self):
        self.best, self.found, self.same = 0.0, [], None

    def root(self) -> _Value:
        here = self
        while here.same is not None:
            if here.same.same is not None:
                here.same = here.same.same
            here = here.same
        return here


class _Names:
    """Assignments in order, by scope."""

    def __init__(self):
        self.values: dict[str, list[_Value]] = {}
        self.scopes: list[list[str]] = [[]]
        self.awaited: dict[str, _Value] = {}
        self.made: list[_Value] = []

    def opened(self) -> None:
        self.scopes.append([])

    def closed(self) -> None:
        if len(self.scopes) > 1:
            for name in self.scopes.pop():
                self.values[name].pop()

    def give(self, name: str, value: _Value) -> None:
        value = value.root()
        waiting = self.awaited.pop(name, None)
        if waiting is not None and (old := waiting.root()) is not value:
            value.best = max(value.best, old.best)
            old.found.clear()  # a word that names a value is none itself
            old.same = value
        value.best = max(value.best, name_score(name))
        self.values.setdefault(name, []).append(value)
        self.scopes[-1].append(name)

    def look(self, name: str) -> _Value:
        if standing := self.values.get(name):
            return standing[-1].root()
        if name not in self.awaited:
            self.awaited[name] = _Value()
        return self.awaited[name].root()

    def literal(self, at: int, end: int, text: str) -> _Value:
        out = _Value()
        out.found.append((at, end, text))
        self.made.append(out)
        return out


def _chosen(word: str) -> bool:
    """Whether a word without quotes looks like a value that someone chose: digits, or capitals inside."""
    return any(c.isdigit() for c in word) or sum(c.isupper() for c in word) > 1 and any(c.islower() for c in word)


def added_spans(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, directly or by way of other names."""
    if "=" not in text and ":" not in text and "</" not in text and "(" not in text:
        return []
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text)]
    names, n = _Names(), len(tokens)
    is_mark = lambda i, c: i < n and tokens[i][0] == "mark" and text[tokens[i][1]] == c

    def inner(i: int) -> tuple[int, int]:
        kind, a, b = tokens[i]
        cut = 3 if kind == "long" else 1
        return a + cut, b - cut

    def is_text(i: int) -> bool:
        return i < n and tokens[i][0] in ("text", "long")

    def strings(i: int) -> tuple[_Value, int]:
        """The value of string i with those joined to it, and the next token."""
        parts, last = [i], i
        while True:
            j = last + 1
            if (is_mark(j, "+") or is_mark(j, ".")) and is_text(j + 1):
                j += 1
            elif not (is_text(j) and not text[tokens[last][2] : tokens[j][1]].strip(" \t")):
                break
            parts.append(j)
            last = j
        value = "".join(text[slice(*inner(k))] for k in parts)
        return names.literal(inner(i)[0], inner(last)[1], value), last + 1

    def value_at(i: int, at: int, op: str) -> tuple[_Value | None, int]:
        """The value that stands at token i, from text position at on, and the next token."""
        if is_text(i) and not text[at : tokens[i][1]].strip(" \t"):
            return strings(i)
        at = _GAP.match(text, at).end()
        if op == ":" and (m := _BLOCK.match(text, at)):
            line, end, first = m.end(), m.end(), None
            indent = None
            while line < len(text):
                stop = text.find("\n", line)
                stop = len(text) if stop < 0 else stop
                body = text[line:stop]
                lead = len(body) - len(body.lstrip(" \t"))
                if body.strip():
                    if not lead or indent is not None and lead < indent:
                        break
                    indent = lead if indent is None else indent
                    first = line + lead if first is None else first
                    end = line + len(body.rstrip())
                line = stop + 1
            while i < n and tokens[i][1] < end:
                i += 1
            return (names.literal(first, end, "".join(text[first:end].split())), i) if first is not None else (None, i)
        m = _BARE.match(text, at)
        if m is None:
            return None, i
        word = m.group()
        while i < n and tokens[i][1] < m.end():
            i += 1
        if _IDENTIFIER.match(word):
            if is_mark(i, "(") or is_mark(i, "["):
                return None, i
            if op != ":" or not _chosen(word) or word in names.values:
                known = names.look(word)
                if _chosen(word) and not names.values.get(word):
                    # Should the name never be given a value, the word itself is one.
                    known.found.append((m.start(), m.end(), word))
                return known, i
            return names.literal(m.start(), m.end(), word), i
        return names.literal(m.start(), m.end(), word), i

    i = 0
    while i < n:
        kind, a, b = tokens[i]
        if kind == "mark":
            if text[a] == "{":
                names.opened()
            elif text[a] == "}":
                names.closed()
            elif text[a] == "(" and is_text(i + 1) and is_mark(i + 2, ",") and is_text(i + 3) and _KEY.match(key := text[slice(*inner(i + 1))]):
                value, i = strings(i + 3)
                names.give(key, value)
                continue
            elif text[a] == "<" and (m := _TAG.match(text, a)):
                names.give(m["name"], names.literal(m.start("bare"), m.end("bare"), m["bare"]))
                while i < n and tokens[i][1] < m.end():
                    i += 1
                continue
            i += 1
            continue
        if kind == "name":
            targets, j = [text[a:b]], i + 1
        elif kind == "text" and _KEY.match(key := text[slice(*inner(i))]):
            targets, j = [key], i + 1
        else:
            i += 1
            continue
        if is_mark(j, "]"):
            j += 1
        if j >= n or tokens[j][0] != "op" or text[tokens[j][1] : tokens[j][2]] not in ("=", ":=", "=>", ":"):
            i += 1
            continue
        op = text[tokens[j][1] : tokens[j][2]]
        if op == ":" and kind == "name" and j + 2 < n and tokens[j + 1][0] == "name" and tokens[j + 2][0] == "op" and text[tokens[j + 2][1] : tokens[j + 2][2]] == "=":
            j, op = j + 2, "="  # a type stands between the name and its value
        value, after = value_at(j + 1, tokens[j][2], op)
        if value is not None:
            # In a = b = "x" the value is a name that the next assignment gives.
            again = after < n and tokens[after][0] == "op" and text[tokens[after][1] : tokens[after][2]] == "=" and op == "=" and tokens[after - 1][0] == "name"
            for name in targets:
                names.give(name, value)
            if again:
                after -= 1
        i = max(after, j + 1)
    out = set()
    for value in [*names.made, *names.awaited.values()]:
        end = value.root()
        if end.best:
            out |= {(x, y) for x, y, word in value.found if end.best * 0.5 + literal_score(word) * 0.5 >= THRESHOLD and literal_score(word) > 0}
    return sorted(out)


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans by start and kind; ends are exclusive and count code points."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    out += [("literal", a, b) for a, b in added_spans(text)]
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans: array of kind, start, end) for every row, over whole texts.

    A null text counts as empty and has no spans; rows stay as they are, however
    often they repeat; other columns are ignored.
    """
    small_batches(df.sparkSession)
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["id", "spans"])

    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)
