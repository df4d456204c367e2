"""Secrets in run-log lines, by a trigram inverted index and regular expressions.

Works on the library's log tables (entry_id, line): requests with keys in their addresses, job files
and tool output. Everything is made of DataFrame functions.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoterra.llm.batches import named
from isoterra.spread import cut


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regular expression and the least length of one of its groups (0: the match)."""

    kind: str
    pattern: str
    group: int
    least: int


# What follows the first line of a private key. Up to its last line anything but another line of dashes may
# stand, such as quoting or indents. Without a last line: headers, base64 in one line, and whole lines of it.
# Repeated groups are counted, since Java's matcher needs stack for each turn of one.
_TO_THE_END = r"[^-]*(?:-{1,4}[^-]+){0,200}-{5,6}END [A-Z ]*PRIVATE KEY-----"
_KEY_LINES = (
    r"(?:[ \t]*\r?\n[ \t]*[A-Za-z-]+: [^\r\n]*){0,9}[ \t\r\n]*[A-Za-z0-9+/=\\]{16,}"
    r"(?:[ \t]+[A-Za-z0-9+/=\\]{16,}){0,60}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/=\\]+){0,500}"
)
# Patterns of the base kinds, then of the kinds this operator adds. A maximal run of hex
# digits is found by the length itself, so the many short runs of plain words are never listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_THE_END}|{_KEY_LINES}|)", 0, 27),
)
RULES = BASE + ADDED
MASK = "[secret]"
# More alternatives than this are not told apart: the part counts as unknown text, which is always safe.
MOST_WAYS = 64

# One way to match a part of a pattern: finished literal runs, and the run at its end that may go on.
Way = tuple[tuple[str, ...], str]


def _set_members(items: list) -> list[str] | None:
    """Characters of a small character class; None for a large or negated one."""
    found: list[str] = []
    for kind, value in items:
        if kind is op.LITERAL:
            found.append(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < 8:
            found += [chr(c) for c in range(value[0], value[1] + 1)]
        else:
            return None
    return found if len(found) <= 8 else None


def _gap(ways: list[Way]) -> list[Way]:
    """After text that is not known, every run is finished."""
    return list(dict.fromkeys(((*done, run) if run else done, "") for done, run in ways))


def _ways(parsed, ways: list[Way]) -> list[Way]:
    """All ways to go on from `ways` through a parsed pattern."""
    for kind, value in parsed:
        if kind is op.LITERAL:
            ways = [(done, run + chr(value).lower()) for done, run in ways]
            continue
        if kind is op.IN and (members := _set_members(value)):
            more = [(done, run + c.lower()) for done, run in ways for c in members]
        elif kind is op.SUBPATTERN:
            more = _ways(value[3], ways)
        elif kind is op.BRANCH:
            more = [w for branch in value[1] for w in _ways(branch, ways)]
        elif kind is op.MAX_REPEAT and value[:2] == (0, 1):
            more = ways + _ways(value[2], ways)
        elif kind is op.MAX_REPEAT and value[0] >= 1:
            more = _gap(_ways(value[2], ways))
        elif kind is op.AT:
            more = ways
        else:
            more = _gap(ways)
        more = list(dict.fromkeys(more))
        ways = more if len(more) <= MOST_WAYS else _gap(ways)
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, in lower case, one of which every match contains in full; empty: no such query."""
    alternatives = []
    for done, run in _ways(parser.parse(pattern), [((), "")]):
        grams = frozenset(r[i : i + 3] for r in (*done, run) for i in range(len(r) - 2))
        if not grams:
            return []
        alternatives.append(grams)
    # An alternative that asks for more than another one adds nothing.
    return sorted((a for a in set(alternatives) if not any(b < a for b in alternatives)), key=sorted)


def trigram_index(log: DataFrame, trigrams: Sequence[str], key: str = "entry_id", line: str = "line") -> DataFrame:
    """Postings (trigram, entry): which entries contain which of the given trigrams, case ignored.

    Only trigrams that some rule asks for are indexed, so the index is a small part of the text.
    """
    lower = F.lower("line")
    found = F.array_compact(F.array(*[F.when(lower.contains(t), F.lit(t)) for t in trigrams]))
    rows = named(log, entry=key, line=line)
    return rows.select(F.explode(found).alias("trigram"), "entry")


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(entry, kinds): entries whose postings meet a query of the kind.

    The queries are a table of their own (a few rows per rule), joined to the postings; an alternative is
    met by an entry that is in the postings of all its trigrams.
    """
    asked = [(kind, n, t, len(grams)) for kind, ways in queries.items() for n, grams in enumerate(ways) for t in sorted(grams)]
    wanted = postings.sparkSession.createDataFrame(asked, "kind string, way int, trigram string, size int")
    met = (
        postings.join(F.broadcast(wanted), "trigram")
        .groupBy("entry", "kind", "way", "size")
        .agg(F.count_distinct("trigram").alias("met"))
        .where("met = size")
    )
    return met.groupBy("entry").agg(F.collect_set("kind").alias("kinds"))


def _places(text: Column, number: int, rule: Rule) -> Column:
    """Matches of one rule as array of (start, number, end) in code points.

    The pieces between the matches, which `split` leaves, and the matches alternate, so adding up their
    lengths gives the places.
    """
    pattern = F.lit(rule.pattern)
    matched = F.regexp_extract_all(text, pattern, 0)
    groups = F.regexp_extract_all(text, pattern, rule.group) if rule.group else matched
    between = F.split(text, rule.pattern, -1)
    triples = F.arrays_zip(between.alias("b"), matched.alias("m"), groups.alias("g"))
    empty = F.array().cast("array<struct<start: int, number: int, end: int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.char_length(t["b"])
        end = begin + F.coalesce(F.char_length(t["m"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end")))
        keep = F.char_length(t["g"]) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    named_triples = F.transform(triples, lambda t: F.struct(t["b"].alias("b"), t["m"].alias("m"), t["g"].alias("g")))
    return F.aggregate(named_triples, start, step, lambda s: s["found"])


def find_secrets(log: DataFrame, rules: Sequence[Rule] = RULES, key: str = "entry_id", line: str = "line") -> DataFrame:
    """All columns of the log and `secrets` (in place of a column of that name): array of (start, number, end), ordered, `number` being the rule's.

    Matches are leftmost and do not overlap within a rule; places count code points, the end is
    exclusive. Rules with mandatory trigrams are verified only in entries that the index names for them;
    rules without read every line. A null line counts as empty; rows that repeat an id are each searched
    (an index hit of one only makes the others candidates); an entry without an id is searched like any
    other; an empty log gives no rows. The text is shuffled once, to meet its candidates by id.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: ways for kind, ways in queries.items() if ways}
    trigrams = sorted({t for ways in indexed.values() for grams in ways for t in grams})
    rows = log.select(*log.columns, F.coalesce(F.col(line), F.lit("")).alias("_line"), F.col(key).alias("_entry"))
    if indexed:
        # The index is written once: the candidates stay the same whatever task is repeated.
        postings = cut(trigram_index(log, trigrams, key, line))
        named_entries = candidates(postings, indexed).select(F.col("entry").alias("_named"), F.col("kinds").alias("_kinds"))
        rows = rows.join(named_entries, rows["_entry"].eqNullSafe(named_entries["_named"]), "left")
    else:
        rows = rows.withColumn("_kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start: int, number: int, end: int>>")
    found = []
    for n, rule in enumerate(rules):
        asked = F.array_contains("_kinds", rule.kind) if queries[rule.kind] else F.lit(True)
        found.append(F.when(asked & F.col("_line").rlike(rule.pattern), _places(F.col("_line"), n, rule)).otherwise(none))
    every = functools.reduce(F.concat, found)
    kept = [c for c in log.columns if c != "secrets"]
    return rows.select(*kept, F.array_sort(every).alias("secrets"))


def span_text(secrets: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Places as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    parts = F.transform(secrets, lambda s: F.concat_ws(":", F.get(kinds, s["number"]), s["start"], s["end"]))
    return F.array_join(parts, ",")


def masked(line: Column, secrets: Column, mask: str = MASK) -> Column:
    """A line with its secrets replaced; secrets that overlap or touch become one mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(line, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        apart = (s["start"] > state["at"]) | (state["at"] == 0)
        more = F.when(apart, F.concat(state["out"], before, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), more.alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(line, state["at"] + 1, F.char_length(line)))

    return F.when(F.size(secrets) > 0, F.aggregate(secrets, start, step, finish)).otherwise(line)
