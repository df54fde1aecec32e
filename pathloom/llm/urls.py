"""URL filters: a broadcast trie over reversed host labels, then path segments; the longest rule decides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of host and path in all rules of a trie, which is broadcast.
MAX_RULE_CHARS = 50_000_000


class UrlTrie:
    """Rules are (verdict, host, path). A rule fits its host and every subdomain if the URL's path starts with its path.

    Of the rules that fit, the one with the most host labels wins, then the longest path; of two verdicts for one
    host and path the first given stays.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        held = 0
        for verdict, host, path in rules:
            held += len(host) + len(path)
            if held > MAX_RULE_CHARS:
                raise ValueError("the rules are too large to broadcast")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, last = path.split("/")  # whole segments, and the beginning of the next
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("ends", {}).setdefault(len(last), {}).setdefault(last, (f"{host}{path}", verdict))
        todo = [self.root]
        while todo:  # the longest beginnings first
            node = todo.pop()
            if "ends" in node:
                node["ends"] = sorted(node["ends"].items(), reverse=True)
            todo += [*node.get("hosts", {}).values(), *node.get("segments", {}).values()]

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        rest = path.split("/")
        best, node = self._below(self.root, rest), self.root
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            best = self._below(node, rest) or best
        return best

    @staticmethod
    def _below(node: dict, rest: list[str]) -> tuple[str, str] | None:
        best = None
        for k, segment in enumerate(rest):
            for length, ends in node.get("ends", ()):  # a look-up for each length, however many rules there are
                if length <= len(segment) and (found := ends.get(segment[:length])):
                    best = found
                    break
            node = node.get("segments", {}).get(segment) if k < len(rest) - 1 else None
            if node is None:
                break
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def judge(df: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (the rule's, else ``default``).

    Null URLs and those without ``://`` have an empty host and path, which only a rule without a host can fit. Host
    and path may hold any characters, line feeds too. Repeated rows each get a verdict; no rows give no rows; columns
    of the four names are replaced; rules are a list in the driver's memory, and more than ``MAX_RULE_CHARS`` of them
    raise ValueError before they are broadcast.
    """
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    host, path = host_and_path(F.col(url_col))
    kept = [df[c] for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = df.select(*kept, host.alias("host"), path.alias("path"))

    def start():
        find = trie.value.find

        def work(paths, hosts):
            found = [find(h, p) for h, p in zip(hosts, paths)]
            return {"rule": [f and f[0] for f in found], "verdict": [f[1] if f else default for f in found]}

        return work

    return append_columns(parts, "path", [("rule", T.StringType()), ("verdict", T.StringType())], start, "host")
