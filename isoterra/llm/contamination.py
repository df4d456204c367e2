"""Passages of held-out items inside stored responses, found by one Aho-Corasick automaton.

Works on the library's stored responses (response_id, body) and a table of held-out texts
(item_id, text). The reference library has no test questions of its own, so the items are general.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

from pyarrow import dataset, fs
from pyspark.sql import DataFrame

from isoterra.llm.batches import Lists, in_batches, named, per_worker
from isoterra.llm.frames import new_folder

WINDOW = 10
# Characters of normalised items in one automaton; more items make more automata, each with a scan of its own.
AUTOMATON_CHARS = 16_000_000
# A-Z becomes a-z and every ASCII character that is no letter or digit becomes a space. Bytes from
# 0x80 on belong to words, so working on bytes and on code points comes to the same.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text."""
    return (text or "").encode().translate(_NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Runs of `size` words; a shorter text, if it has words, is one run."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def automaton(items: list[tuple], size: int = WINDOW):
    """Aho-Corasick automaton over the windows of (item id, text); each carries its length in words and its items."""
    import ahocorasick

    owners: dict[bytes, set] = defaultdict(set)
    for item, text in items:
        for window in windows(normal_words(text), size):
            owners[window].add(item)
    found = ahocorasick.Automaton()
    for window, ids in owners.items():
        # A space on either side keeps matches to whole words; Latin-1 maps every byte to one character.
        found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(ids)))
    found.make_automaton()
    return found


def matches(found, words: list[bytes]) -> list[tuple[int, int, tuple]]:
    """Occurrences as (first word, end word, items) in a normalised text, scanned once."""
    if not len(found) or not words:
        return []
    line = f" {b' '.join(words).decode('latin-1')} "
    hits = [(end, value) for end, value in found.iter(line)]
    if not hits:
        return []
    # The end of a match is a space; counting spaces up to it gives the number of words before it.
    ends, word, counted = {}, 0, 0
    for end in sorted({e for e, _ in hits}):
        word += line.count(" ", counted, end)
        counted = end
        ends[end] = word
    return [(ends[e] - count, ends[e], items) for e, (count, items) in hits]


def word_offsets(text: str, words: list[int]) -> list[tuple[int, int]]:
    """Character offsets (end exclusive) in the original text of the words with the given numbers, ascending."""
    data, wanted, out = text.encode(), iter(words), []
    want, at, characters = next(wanted, None), 0, 0
    for number, match in enumerate(_WORD.finditer(data)):
        if want is None:
            break
        if number == want:
            start = characters + len(data[at : match.start()].decode())
            characters = start + len(match.group().decode())
            at = match.end()
            out.append((start, characters))
            want = next(wanted, None)
    return out


def _spans(hits: list[tuple[int, int, tuple]]) -> list[list[int]]:
    """Joined word ranges of all matches."""
    joined: list[list[int]] = []
    for first, end, _ in sorted(h[:2] + (None,) for h in hits):
        if joined and first <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([first, end])
    return joined


def _groups(folder: str, limit: int) -> Iterator[list[tuple]]:
    """Items of a written table in groups of at most `limit` characters (one longer item makes a group)."""
    store, root = fs.FileSystem.from_uri(folder)
    group, held = [], 0
    for batch in dataset.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=1024):
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            if group and held + len(text or "") > limit:
                yield group
                group, held = [], 0
            group.append((item, text))
            held += len(text or "")
    yield group


def _automata(folder: str, limit: int, size: int) -> Iterator[object]:
    """The automata of all items, one after the other; where one is enough, the worker keeps it."""

    def only() -> object | None:
        groups = _groups(folder, limit)
        first = next(groups)
        return automaton(first, size) if next(groups, None) is None else None

    kept = per_worker(f"automaton {folder} {limit} {size}", only)
    if kept is not None:
        yield kept
    else:
        for group in _groups(folder, limit):
            yield automaton(group, size)


def find_contamination(
    responses: DataFrame,
    held_out: DataFrame,
    response_id: str = "response_id",
    body: str = "body",
    item_id: str = "item_id",
    text: str = "text",
    size: int = WINDOW,
    automaton_chars: int = AUTOMATON_CHARS,
) -> DataFrame:
    """Per response: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A window is `size` words in a row of a held-out text; a word of a body inside any occurrence of
    any window is hit. `n_items` counts the items with such windows, `items_sha256` is the digest of
    their ids, sorted as text and joined by commas, and `spans` are the hit ranges as character offsets
    of the original body. Null and empty bodies have no words; rows that repeat an id are judged one by
    one; an empty table of items hits nothing, an item without words has no window.

    The items are written once to the shared folder and the tasks build their automaton from there, so
    the driver never holds them. An automaton takes at most `automaton_chars` characters of items; where
    that is not enough, a task builds one after the other and scans its batch of bodies with each.
    """
    folder = new_folder(held_out.sparkSession, "items")
    named(held_out, item=item_id, text=text).write.parquet(folder)
    rows = named(responses, id=response_id, body=body)

    def judge(lists: Lists) -> Lists:
        texts = [normal_words(t) for t in lists["body"]]
        hits: list[list] = [[] for _ in texts]
        for found in _automata(folder, automaton_chars, size):
            for n, words in enumerate(texts):
                hits[n] += matches(found, words)
        out: Lists = {k: [] for k in ("id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")}
        for i, body_text, words, own in zip(lists["id"], lists["body"], texts, hits):
            ranges = _spans(own)
            ids = sorted({str(item) for _, _, items in own for item in items})
            edges = word_offsets(body_text or "", sorted({w for a, b in ranges for w in (a, b - 1)})) if ranges else []
            edge = dict(zip(sorted({w for a, b in ranges for w in (a, b - 1)}), edges))
            hit = sum(b - a for a, b in ranges)
            out["id"].append(i)
            out["n_words"].append(len(words))
            out["n_hit"].append(hit)
            out["n_items"].append(len(ids))
            out["items_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            out["contaminated"].append(hit > 0)
            out["spans"].append([{"start": edge[a][0], "end": edge[b - 1][1]} for a, b in ranges])
        return out

    kind = responses.schema[response_id].dataType.simpleString()
    schema = (
        f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "spans array<struct<start: long, end: long>>"
    )
    return in_batches(rows, judge, schema).withColumnRenamed("id", response_id)
