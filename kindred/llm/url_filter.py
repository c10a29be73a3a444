"""URL filters: a trie over reversed host labels, each node with a trie over path segments.

Rules are given in the driver, so their size is known; it is checked against ``MAX_RULE_BYTES`` before the
trie is broadcast. A url is judged by walking its host from the last label inwards and, at every node
passed, its path from the left. Rules with more host labels win over rules with fewer, then longer paths
over shorter ones; if a block and an allow entry are the same rule, block wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULE_BYTES = 64 << 20
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    found = _URL.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def _segments(path: str) -> list[str]:
    """``/en/x`` as ``/``, ``en/``, ``x``: every segment keeps its slash."""
    return re.findall(r"[^/]*/|[^/]+", path)


class PathTrie:
    """Path prefixes by whole segments; a rule that ends inside a segment is kept as a partial one."""

    def __init__(self) -> None:
        self.rule: tuple[str, str] | None = None
        self.children: dict[str, PathTrie] = {}
        self.partial: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []

    def add(self, segments: list[str], entry: tuple[str, str]) -> None:
        if not segments:
            self.rule = _stricter(self.rule, entry)
        elif segments[0].endswith("/"):
            self.children.setdefault(segments[0], PathTrie()).add(segments[1:], entry)
        else:
            self.partial[segments[0]] = _stricter(self.partial.get(segments[0]), entry)
            self.lengths = sorted({*self.lengths, len(segments[0])})

    def longest(self, segments: list[str]) -> tuple[str, str] | None:
        best, node = None, self
        for segment in [*segments, ""]:
            best = node.rule or best
            for n in node.lengths:
                if n > len(segment):
                    break
                best = node.partial.get(segment[:n]) or best
            node = node.children.get(segment)
            if node is None:
                break
        return best


class HostTrie:
    def __init__(self) -> None:
        self.children: dict[str, HostTrie] = {}
        self.paths: PathTrie | None = None

    def add(self, labels: list[str], segments: list[str], entry: tuple[str, str]) -> None:
        node = self
        for label in labels:
            node = node.children.setdefault(label, HostTrie())
        node.paths = node.paths or PathTrie()
        node.paths.add(segments, entry)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        best, node, segments = None, self, _segments(path)
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = node.paths.longest(segments) or best
        return best


def _stricter(old: tuple[str, str] | None, new: tuple[str, str]) -> tuple[str, str]:
    return old if old is not None and old[1] == "block" else new


def build_trie(rules: Iterable[tuple[str, str]]) -> HostTrie:
    """``rules``: (``block`` or ``allow``, host and path such as ``example.net/en/``)."""
    trie, size = HostTrie(), 0
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or not rule.partition("/")[0]:
            raise ValueError(f"not a rule: {verdict} {rule}")
        size += len(rule.encode())
        if size > MAX_RULE_BYTES:
            raise ValueError("the rules are too large to broadcast; split the list")
        host, slash, path = rule.partition("/")
        trie.add(host.translate(LOWER).split(".")[::-1], _segments(slash + path), (rule, verdict))
    return trie


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` to every row.

    A null url, an empty one and one without ``://`` have an empty host and path, fit no rule and get
    ``default``. Columns of these four names that ``pages`` has already are replaced. Rows are kept as they
    are, repeated ones too; no rules at all give every row ``default``.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        walk = trie.value.longest
        rows = []
        for u in urls:
            host, path = split_url(u)
            rule, verdict = walk(host, path) or (None, default)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in new or c == url]
    source = pages.select(*kept, judge(F.col(url).cast("string")).alias("_judged"))
    return source.select(*[c for c in kept if c.lower() not in new], *[f"_judged.{c}" for c in new])
