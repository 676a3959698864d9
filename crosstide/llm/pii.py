"""Personal data: detected entities get keyed surrogates of the same type and format.

A surrogate is a permutation of the entities that share its format. The
symbols that may vary (digits, letters by case-free class, octets, names of a
list) are read as one number below n; a keyed Feistel network with cycle walking
permutes those numbers (p), and the surrogate is p^-1(p(x) + 1 mod n). So

* equal entities get equal surrogates in every document, without any shared
  table (coreference), whatever their letters' case;
* different entities get different surrogates (distinctness), and none gets
  itself;
* type, punctuation, field range, script, case, check digits and the gender of
  names stay as they are.

Letters take the place of letters of their script and kind: by the sets of
LETTERS, or else by their Unicode page (letters of one category, script and
case within 256 code points). Where nothing can vary, a keyed pseudonym stands:
an entity never keeps its form.

Where two formats could meet (listed and unlisted names) the walk skips what
belongs to the other: that is the collision check.

Names are detected after a title. The parts of a name that is so detected are
then sought in the whole text as whole words and get the same surrogates, and
the words of an e-mail address's local part get those that they have as names.
A name that never stands after a title is not detected.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm._common import small_batches

#: For tests and examples only: production passes a secret key of its own.
DEMONSTRATION_KEY = b"crosstide demonstration key"
KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "name")

#: Titles by gender, and given names by gender.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sir"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Lady"], "": ["Dr", "Prof"]}
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Kevin Brian Hans Peter Klaus Jürgen Pierre Jean Michel Louis Carlos José Luis Miguel".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Laura Anna Ursula Monika Petra Sabine Marie Nathalie Isabelle Sophie María Carmen Ana Lucía".split(),
}
#: Letters that take one another's place, by script and kind.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "äöü", "âêîôû", "çñ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]

#: Symbols that are permuted as one number.
MOVED_TOGETHER = 64

_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CAPITAL = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]*+(?:[-'][^\W\d_]++)?"
PATTERNS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("card", re.compile(r"(?<![A-Za-z0-9.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])(?!\.\d)")),
    ("phone", re.compile(r"(?<![\w+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w)(?!\.\d)")),
    ("name", re.compile(rf"(?<!\w)(?:{_TITLE})\.?[ ](?P<name>{_CAPITAL}(?:[ ]{_CAPITAL}){{0,2}})")),
]
_HINTS = {"email": "@", "iban": "", "card": "", "phone": "", "ssn": "-", "ip": ".", "name": ""}
_ANY_TITLE = re.compile(rf"\b(?:{_TITLE})\b")
_DIGIT = re.compile(r"\d")
_NAME_WORD = re.compile(r"[^\W\d_]+")


class Permutation:
    """Keyed permutation of 0 .. n-1 and the derangement made from it."""

    ROUNDS = 8

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.half = max(1, -(-(n - 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.size = -(-self.half // 8)
        self.base = hashlib.blake2b(tweak.encode(), key=hashlib.blake2b(key, digest_size=32).digest(), digest_size=32).digest()

    def _round(self, i: int, x: int) -> int:
        data, out = x.to_bytes(self.size, "big"), b""
        while len(out) < self.size:
            out += hashlib.blake2b(data + len(out).to_bytes(2, "big") + bytes([i]), key=self.base, digest_size=min(64, self.size)).digest()
        return int.from_bytes(out[: self.size], "big") & self.mask

    def forward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(self.ROUNDS):
                a, b = b, a ^ self._round(i, b)
            x = (a << self.half) | b
            if x < self.n:
                return x

    def backward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(self.ROUNDS)):
                a, b = b ^ self._round(i, a), a
            x = (a << self.half) | b
            if x < self.n:
                return x

    def move(self, x: int) -> int:
        """A bijection without fixed points, unless n is 1."""
        return self.backward((self.forward(x) + 1) % self.n)


def _permuted(key: bytes, tweak: str, fields: list[tuple[int, int]], allowed: Callable[[list[int]], bool] = lambda _: True) -> list[int]:
    """Fields (value, radix) moved together; combinations that are not allowed are walked past.

    Long rows of fields move in parts of MOVED_TOGETHER, which no listed name reaches.
    """
    if len(fields) > MOVED_TOGETHER:
        parts = [fields[i : i + MOVED_TOGETHER] for i in range(0, len(fields), MOVED_TOGETHER)]
        shape = hashlib.blake2b(tweak.encode(), digest_size=16).hexdigest()
        return [v for i, part in enumerate(parts) for v in _permuted(key, f"{shape}|{i}", part)]
    n = 1
    for _, radix in fields:
        n *= radix
    if n <= 1:
        return [v for v, _ in fields]
    turn = Permutation(key, f"{tweak}|{n}", n)
    x = 0
    for value, radix in fields:
        x = x * radix + value
    while True:
        x = y = turn.move(x)
        out = []
        for _, radix in reversed(fields):
            y, v = divmod(y, radix)
            out.append(v)
        if allowed(out[::-1]):
            return out[::-1]


@lru_cache(1 << 14)
def _group(c: str) -> str:
    """The letters that may take the place of a letter in lower case; none for other characters and lone letters."""
    listed = next((g for g in LETTERS if c in g), None)
    if listed or not c.isalpha():
        return listed or ""
    kind = lambda x: (unicodedata.category(x), unicodedata.name(x, "").partition(" ")[0], x.upper() != x, len(x.upper()) == len(x.lower()) == 1 and x.upper().lower() == x)
    own, page = kind(c), ord(c) >> 8 << 8
    alike = "".join(x for x in map(chr, range(page, page + 256)) if kind(x) == own and not any(x in g for g in LETTERS))
    return alike if own[3] and len(alike) > 1 else ""


def _symbols(text: str) -> list[tuple[int, str] | None]:
    """For each character its place and set, or None where it stays."""
    out: list[tuple[int, str] | None] = []
    for c in text:
        if c.isdecimal():
            zero = ord(c) - int(c)
            out.append((int(c), "".join(map(chr, range(zero, zero + 10)))))
        else:
            lower = c.lower()
            group = _group(lower) if len(lower) == 1 else ""
            out.append((group.index(lower), group) if group else None)
    return out


def _spelled(text: str, symbols: list, values: list[int]) -> str:
    moved = iter(values)
    chars = []
    for c, s in zip(text, symbols):
        new = s[1][next(moved)] if s else c
        chars.append(new.upper() if c.isupper() else new)
    return "".join(chars)


def _shape(symbols: list, text: str) -> str:
    """Each set by its first character, in brackets; what stays as it is."""
    return "".join(f"[{s[1][0]}]" if s else f"{c.lower()}," for c, s in zip(text, symbols))


def _pseudonym(key: bytes, kind: str, text: str) -> str:
    """Letters that stand for an entity of which nothing can vary."""
    number = int.from_bytes(hashlib.blake2b(f"{kind}|{text}".encode(), key=hashlib.blake2b(key, digest_size=32).digest(), digest_size=10).digest(), "big")
    letters = ""
    while number:
        number, k = divmod(number, 26)
        letters += chr(97 + k)
    return letters.capitalize()


def _by_class(key: bytes, kind: str, text: str, allowed: Callable[[str], bool] = lambda _: True) -> str:
    symbols = _symbols(text)
    fields = [(s[0], len(s[1])) for s in symbols if s]
    return _spelled(text, symbols, _permuted(key, f"{kind}|{_shape(symbols, text)}", fields, lambda v: allowed(_spelled(text, symbols, v))))


_LETTERS_RUN = re.compile(r"[^\W\d_]{3,}")


def _email(key: bytes, text: str) -> str:
    """Words of the local part as parts of names, all else by class; the top-level domain stays."""
    local, _, domain = text.rpartition("@")
    *labels, top = domain.split(".")
    words = _LETTERS_RUN.findall(local)
    rest = _LETTERS_RUN.sub("\0", local)
    moved = iter([_name_part(key, w) for w in words])
    local = "".join(next(moved) if c == "\0" else c for c in _by_class(key, "local", rest))
    return f"{local}@{'.'.join(_by_class(key, 'domain', label) for label in labels)}.{top}"


def _luhn(digits: list[int]) -> int:
    """The check digit that follows these digits."""
    return -sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10


def _redigit(text: str, digits: list[int]) -> str:
    new = iter(digits)
    return "".join(chr(ord(c) - int(c) + next(new)) if c.isdecimal() else c for c in text)


def _card(key: bytes, text: str) -> str:
    digits = [int(c) for c in text if c.isdecimal()]
    excess = (digits[-1] - _luhn(digits[:-1])) % 10  # 0 for valid numbers; stays
    body = _permuted(key, f"card|{len(digits)}|{digits[0]}|{excess}", [(d, 10) for d in digits[1:-1]])
    body = [digits[0], *body]
    return _redigit(text, [*body, (_luhn(body) + excess) % 10])


def _phone(key: bytes, text: str) -> str:
    code = re.match(r"\+\d{1,3}(?=\D)", text)
    head = code.end() if code else 0
    rest = text[head:]
    shape = re.sub(r"\d", "9", rest)
    digits, groups = [int(c) for c in rest if c.isdecimal()], [len(g) for g in re.findall(r"\d+", rest)]
    firsts = {sum(groups[:i]) for i in range(min(2, len(groups)))}  # area and exchange do not begin with 0 or 1
    fields = [(d - 2, 8) if i in firsts and d > 1 else (d - 0, 2) if i in firsts else (d, 10) for i, d in enumerate(digits)]
    moved = _permuted(key, f"phone|{text[:head]}|{shape}|{[r for _, r in fields]}", fields)
    return text[:head] + _redigit(rest, [v + 2 if r == 8 else v for v, (_, r) in zip(moved, fields)])


def _ip(key: bytes, text: str) -> str:
    return ".".join(map(str, _permuted(key, "ip", [(int(o), 256) for o in text.split(".")])))


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(key: bytes, text: str) -> str:
    plain = text.replace(" ", "")
    symbols = [(int(c), "0123456789") if c.isdigit() else (ord(c) - 65, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in plain[4:]]
    shape = "".join("9" if c.isdigit() else "A" for c in plain[4:])
    body = "".join(s[1][v] for s, v in zip(symbols, _permuted(key, f"iban|{plain[:2]}|{shape}", [(s[0], len(s[1])) for s in symbols])))
    new = iter(f"{plain[:2]}{98 - _iban_number(body + plain[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


_LISTED = {name.lower(): (gender, i) for gender, names in GIVEN.items() for i, name in enumerate(names)}


def _varies(text: str) -> bool:
    return any(_symbols(text))


def _name_part(key: bytes, text: str) -> str:
    """A listed given name becomes another of its gender; other names are respelled but for their last letter."""
    if text.lower() in _LISTED:
        gender, at = _LISTED[text.lower()]
        new = GIVEN[gender][Permutation(key, f"given|{gender}", len(GIVEN[gender])).move(at)]
        return new.upper() if text.isupper() else new.lower() if text.islower() else new
    if len(text) < 3 or not _varies(text[:-1]):
        return _by_class(key, "name", text)
    return _by_class(key, f"name|{text[-1].lower()}", text[:-1], lambda s: (s + text[-1]).lower() not in _LISTED) + text[-1]


def _name(key: bytes, text: str) -> str:
    return re.sub(r"[^ '-]+", lambda m: _name_part(key, m.group()), text)


_MAKERS = {"email": _email, "phone": _phone, "card": _card, "ip": _ip, "ssn": lambda k, t: _by_class(k, "ssn", t), "iban": _iban, "name": _name}


@lru_cache(1 << 16)
def surrogate(key: bytes, kind: str, text: str) -> str:
    """Another entity of the kind and format, or a pseudonym where the format leaves none."""
    made = _MAKERS[kind](key, text)
    return made if made != text else _pseudonym(key, kind, text)


def _valid(kind: str, text: str) -> bool:
    if kind == "iban":
        plain = text.replace(" ", "")
        return 15 <= len(plain) <= 34 and _iban_number(plain[4:] + plain[:4]) % 97 == 1
    if kind == "phone":
        return 9 <= sum(c.isdigit() for c in text) <= 15
    if kind == "card":
        return len(set(text) - {" ", "-"}) > 1
    return True


def _beside(taken: list[tuple[int, int, str]], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """taken with those of found that meet none of it; both are in order."""
    out, i = [], 0
    for span in found:
        while i < len(taken) and taken[i][1] <= span[0]:
            i += 1
        if i == len(taken) or span[1] <= taken[i][0]:
            out.append(span)
    return sorted(taken + out)


def _capitalised(text: str, lo: int, hi: int) -> int:
    """Where the name ends: before its first word in lower case."""
    at = lo
    for word in text[lo:hi].split(" "):
        if word[:1].islower():
            return max(lo, at - 1)
        at += len(word) + 1
    return hi


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what does not overlap, in order; earlier kinds of PATTERNS come first, parts of known names last."""
    taken: list[tuple[int, int, str]] = []
    digits = _DIGIT.search(text) is not None
    for kind, pattern in PATTERNS:
        if kind == "name":
            if not _ANY_TITLE.search(text):
                continue
        elif not digits and kind != "email" or _HINTS[kind] not in text:
            continue
        found = []
        for m in pattern.finditer(text):
            lo, hi = m.span("name") if kind == "name" else m.span()
            if kind == "name":
                hi = _capitalised(text, lo, hi)
            if lo < hi and _valid(kind, text[lo:hi]):
                found.append((lo, hi, kind))
        taken = _beside(taken, found)
    # A word of two letters is a name of its own only in scripts without case.
    parts = {w for lo, hi, kind in taken if kind == "name" for w in _NAME_WORD.findall(text[lo:hi]) if len(w) > 2 or len(w) == 2 and w.upper() == w.lower()}
    if parts:
        again = [(m.start(), m.end(), "name") for m in _NAME_WORD.finditer(text) if m.group() in parts]
        taken = _beside(taken, again)
    return [(kind, a, b) for a, b, kind in taken]


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    out, at, found = [], 0, []
    for kind, a, b in entities(text):
        new = surrogate(key, kind, text[a:b])
        out += [text[at:a], new]
        found.append((kind, a, b, new))
        at = b
    return "".join([*out, text[at:]]) if found else text, found


def anonymise(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, text with surrogates, entities: array of kind, start, end, surrogate) for every row.

    Places count code points of the old text. A null text stays null and an empty
    one empty, without entities; texts without entities stay as they are. Rows
    that repeat stay; other columns are ignored.
    """
    small_batches(df.sparkSession)
    chosen = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)
    kinds = dict(chosen.dtypes)
    entity = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())])
    names = ["_id", *keep, "_text", "entities"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(None, []) if t is None else replaced(t, key) for t in batch.column(1).to_pylist()]
            found = [[dict(zip(("kind", "start", "end", "surrogate"), e)) for e in es] for _, es in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([t for t, _ in made], pa.string()), pa.array(found, pa.list_(entity))], names)

    schema = ", ".join([f"_id {kinds['_id']}", *[f"`{c}` {kinds[c]}" for c in keep], "_text string, entities array<struct<kind:string,start:bigint,end:bigint,surrogate:string>>"])
    return chosen.mapInArrow(run, schema).withColumnsRenamed({"_id": id_col, "_text": text_col})
