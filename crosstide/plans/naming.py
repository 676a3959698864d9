"""References: {repo}.{directory}.{node}-{output}, shortened where the node has its directory's name."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterable
from dataclasses import dataclass

from crosstide.operators.spec import SpecError

#: Kinds of nodes, and names that the syntax keeps for itself.
KINDS = ("field", "factor", "alpha")
RESERVED = frozenset(["all", "nodes", "outputs", "deps", "code", "params", "ops", "region", "universe", "lookback", "dims", "grid", "dtype", "sim", "booksize", "return_metric", "cost_model"])
LONGEST_NAME = 40
_WORDS = re.compile(r"[a-z][a-z0-9]*(?:_[a-z0-9]+)*")
_OWNER = re.compile(r"[a-z][a-z0-9]*")


@dataclass(frozen=True, order=True)
class Ref:
    repo: str
    directory: str
    node: str
    output: str

    @property
    def leaf(self) -> str:
        return self.output if self.node == self.directory else f"{self.node}-{self.output}"

    @property
    def kind(self) -> str:
        return self.node.partition("_")[0]

    @property
    def owner(self) -> str:
        return self.node.split("_")[1]

    def __str__(self) -> str:
        return ".".join((self.repo, self.directory, self.leaf))


def split_node(name: str, where: str = "") -> tuple[str, str, str]:
    """kind, owner and short name of {kind}_{owner}_{name}."""
    kind, _, rest = name.partition("_")
    owner, _, short = rest.partition("_")
    if kind not in KINDS or not short:
        raise SpecError(f"{where or name}: a node is named kind_owner_name with kind one of {', '.join(KINDS)}, not {name!r}")
    if not _OWNER.fullmatch(owner):
        raise SpecError(f"{where or name}: the owner in {name!r} must be one lower-case word")
    return kind, owner, short


def parse_ref(text: str) -> Ref:
    parts = text.split(".")
    if len(parts) != 3:
        raise SpecError(f"{text!r} is no reference: it needs repo.directory.node-output")
    repo, directory, leaf = parts
    if text != text.lower():
        raise SpecError(f"{text!r}: references are lower-case")
    for what, part in (("repo", repo), ("directory", directory)):
        if not _WORDS.fullmatch(part):
            raise SpecError(f"{text!r}: the {what} {part!r} is not a lower-case name")
    node, hyphen, output = leaf.partition("-")
    if not hyphen:
        node, output = directory, leaf
    elif node == directory:
        raise SpecError(f"{text!r}: the node has its directory's name, so write {repo}.{directory}.{output}")
    if not output:
        raise SpecError(f"{text!r}: the output has no name")
    if "-" in output:
        raise SpecError(f"{text!r}: a hyphen stands only between node and output")
    split_node(node, text)
    return Ref(repo, directory, node, output)


def is_wildcard(text: str) -> bool:
    return text.endswith(("-*", ".*"))


def expand(pattern: str, known: Iterable[str]) -> list[str]:
    """The known references that a wildcard stands for; other names stand for themselves."""
    return sorted(k for k in known if k.startswith(pattern[:-1])) if is_wildcard(pattern) else [pattern]


def check_name(name: str, what: str) -> None:
    """Short names: lower-case words joined by _, usable as Python keyword arguments."""
    if not isinstance(name, str) or not _WORDS.fullmatch(name):
        raise SpecError(f"{what} {name!r}: use lower-case letters, digits and single underscores")
    if len(name) > LONGEST_NAME:
        raise SpecError(f"{what} {name!r} is longer than {LONGEST_NAME} characters")
    if keyword.iskeyword(name) or not name.isidentifier():
        raise SpecError(f"{what} {name!r} cannot be a keyword argument")
    if name in RESERVED:
        raise SpecError(f"{what} {name!r} is reserved")
    if name.endswith("_tc"):
        raise SpecError(f"{what} {name!r}: _tc marks a template only")
