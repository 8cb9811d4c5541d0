"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression with an action. The tokens (runs of a-z and 0-9) that any match must hold whole are taken from the parsed
expression; the one that is rarest over all URLs becomes the rule's key, and rules without one are always candidates. A URL's own
tokens fetch its candidates, and only those run their regular expressions. Of the rules that match, the one of the highest priority wins, then the
longest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that a task holds at once; more rules make more passes over the URLs, each keeping the best so far.
PASS_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN_CHARS = frozenset(LOWER + UPPER + "0123456789")
_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``literals`` are whole tokens, lower-cased, of every match. Of rules that match the higher
    ``priority`` wins, then the longer ``name``, then the earlier in order."""

    name: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    priority: int = 0


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """The tokens that every text with a match of ``pattern`` holds whole, in order.

    A run of literal characters counts if what stands on both sides is no token character in any match: another literal, a set of such characters, a word boundary
    or an end of the text. Alternatives, options, look-arounds and what may repeat give no tokens.
    """
    #: Literal token characters, "" for what ends a token, None for what may go on with one.
    line: list[str | None] = []

    def plain(kind, value) -> bool:
        """Whether an item of a set holds no token character."""
        if kind is sre.LITERAL:
            return chr(value) not in _TOKEN_CHARS and value < 128
        if kind is sre.RANGE:
            return not any(chr(c) in _TOKEN_CHARS for c in range(value[0], min(value[1], 127) + 1)) and value[1] < 128
        return kind is sre.CATEGORY and value is sre.CATEGORY_SPACE

    def walk(items) -> None:
        for kind, value in items:
            if kind is sre.LITERAL:
                c = chr(value)
                line.append(c.lower() if c in _TOKEN_CHARS else "" if value < 128 else None)
            elif kind is sre.AT:
                line.append("" if value in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING, sre.AT_BOUNDARY) else None)
            elif kind is sre.IN:
                line.append("" if all(plain(*x) for x in value) else None)
            elif kind is sre.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            else:
                line.append(None)

    parsed = parser.parse(pattern)
    if parsed.state.flags & (re.VERBOSE | re.IGNORECASE | re.MULTILINE):
        return ()
    walk(parsed)
    found, at = [], 0
    while at < len(line):
        end = at
        while end < len(line) and line[end]:
            end += 1
        # a match may begin and end amid a token of the text
        if end > at and at > 0 and line[at - 1] == "" and end < len(line) and line[end] == "":
            found.append("".join(line[at:end]))
        at = end + 1
    return tuple(dict.fromkeys(found))


def pattern_rule(action: str, pattern: str, priority: int = 0) -> Rule:
    """A rule by a Python regular expression, named by itself."""
    return Rule(pattern, action, pattern, literal_tokens(pattern), priority)


def prefix_rule(action: str, rule: str, priority: int = 1) -> Rule:
    """A rule for a host with its subdomains, and a path prefix: ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    text = host.translate(_LOWER) + slash + path
    pattern = r"\A(?:[^/]*\.)?" + re.escape(text)
    # the host begins at the text's start or behind a point, so its first token is whole
    return Rule(text, action, pattern, literal_tokens(r"\A" + re.escape(text)), priority)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def tokens(text: str) -> set[str]:
    return set(_TOKEN.findall(text.translate(_LOWER)))


def token_counts(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each literal token of the rules in host or path, over all URLs; one row for each token of the rules comes back."""
    wanted = sorted({t for r in rules for t in r.literals})
    if not wanted:
        return {}
    text = F.translate(F.concat(*host_path(F.col(url_col))), UPPER, LOWER)
    found = urls.select(F.explode(F.array_distinct(F.split(text, "[^a-z0-9]+"))).alias("token"))
    keys = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    return {r.token: r["count"] for r in found.join(keys, "token", "left_semi").groupBy("token").count().collect()}


def index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """The rules by their rarest literal token (ties by code point), and those without one."""
    by_token: dict[str, list[int]] = {}
    always = []
    for k, rule in enumerate(rules):
        if rule.literals:
            by_token.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            always.append(k)
    return by_token, always


def judge(urls: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: id_col, host, path, rule (the winner's name; null if none matches), verdict, candidates (regular expressions run).

    Null URLs and those without `://` have an empty host and path, which rules are searched in like others. Of several winners the one that is
    earlier in ``rules`` counts. Repeated rows are judged alike, null ids stay. A URL of any length is judged whole. Other columns are left out, so
    none can clash. An empty table gives no rows; without rules every verdict is ``default``.
    """
    host, path = host_path(F.col(url_col))
    rows = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.lit(-1).alias("best"), F.lit(0).alias("candidates"))
    passes = [range(at, min(at + PASS_RULES, len(rules))) for at in range(0, len(rules), PASS_RULES)]
    counts = token_counts(urls, rules, url_col)
    # the place of each rule in the order of winners; a URL keeps the least
    order = sorted(range(len(rules)), key=lambda k: (-rules[k].priority, -len(rules[k].name), k))
    ranked = [rules[k] for k in order]
    for part in passes:
        own = [ranked[k] for k in part]
        by_token, always = index(own, counts)
        patterns = [r.pattern for r in own]

        def run(batches: Iterator[pa.RecordBatch], by_token=by_token, always=always, patterns=patterns, start=part.start) -> Iterator[pa.RecordBatch]:
            compiled: dict[int, re.Pattern] = {}  # only rules that are fetched
            for batch in batches:
                best, tried = batch.column("best").to_pylist(), batch.column("candidates").to_pylist()
                for k, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                    text = host + path
                    found = sorted([*always, *(r for t in tokens(text) for r in by_token.get(t, ()))])
                    for r in found:
                        if 0 <= best[k] < r + start:
                            break
                        tried[k] += 1
                        if r not in compiled:
                            compiled[r] = re.compile(patterns[r])
                        if compiled[r].search(text):
                            best[k] = r + start
                            break
                yield pa.record_batch([batch.column("id"), batch.column("host"), batch.column("path"), pa.array(best, pa.int32()), pa.array(tried, pa.int32())], ["id", "host", "path", "best", "candidates"])

        rows = rows.mapInArrow(run, f"id {dict(urls.dtypes)[id_col]}, host string, path string, best int, candidates int")

    winners = urls.sparkSession.createDataFrame([(k, r.name, r.action) for k, r in enumerate(ranked)], "best int, rule string, action string")
    found = rows.join(winners, "best", "left")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"), "candidates")
