"""Quality of place names by what a public vocabulary makes of them.

Works on the library's places (place_id, name), one text per place. Text in the languages a vocabulary
was made for takes few tokens per character and no single bytes, and uses many different tokens;
noise, symbol soup and repetition do not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from isoterra.llm.batches import Lists, in_batches, named, per_worker

SYMBOLS = "#*$%&|<>"
FEW_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
# Different words whose tokens a worker remembers.
KEPT = 300_000


@dataclass(frozen=True)
class Band:
    """Limits of one script; the entropy counts only from `entropy_tokens` tokens on."""

    least_chars: float
    most_chars: float
    most_byte_share: float
    least_entropy: float
    entropy_tokens: int = 128


# The limits per script, and first and last code points of the letters of a script.
BANDS = {
    "latin": Band(1.0, 8.0, 0.10, 4.5),
    "greek": Band(0.8, 6.0, 0.30, 4.0),
    "cyrillic": Band(0.8, 7.0, 0.30, 4.0),
    "arabic": Band(0.5, 6.0, 0.60, 3.5),
    "hebrew": Band(0.5, 6.0, 0.60, 3.5),
    "indic": Band(0.3, 6.0, 0.90, 3.0),
    "cjk": Band(0.3, 4.0, 0.90, 3.5),
    "other": Band(0.2, 12.0, 1.00, 3.0),
}
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "cjk": [(0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)],
}


class Words:
    """Tokens of single words with a sentence-piece vocabulary; words met before are remembered."""

    def __init__(self, vocabulary: str, kept: int = KEPT):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.kept, self.ids = kept, {}

    def encode(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Token ids of texts that are given as words."""
        if len(self.ids) > self.kept:
            self.ids = {}
        missing = list(set().union(*texts).difference(self.ids))
        encoded = self.pieces.encode([w.decode() for w in missing], num_threads=1)
        self.ids.update(zip(missing, [np.array(i, "<u4").tobytes() for i in encoded]))
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, words)), "<u4") for words in texts]


def repeated_words(words: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """Words inside windows of `size` words that the text has twice or more, first ones included."""
    count = len(words) - size + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    # Numbers of longer and longer runs, each renumbered densely so that they never overflow or collide.
    runs = codes[:count]
    for n in range(1, size):
        _, runs = np.unique(runs * len(numbers) + codes[n : n + count], return_inverse=True)
    times = np.bincount(runs)
    starts = np.flatnonzero(times[runs] > 1)
    if not len(starts):
        return 0
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(inside)[:-1]))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.encode().split():
            seen.add(line)
    return again


def script_of(text: str) -> str:
    """The script that most letters of a text belong to; `other` without any."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "other"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    counts = {s: sum(int(np.count_nonzero((points >= a) & (points <= b))) for a, b in ranges) for s, ranges in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def entropy(ids: np.ndarray) -> float:
    """Shannon entropy in bits of the token frequencies of one text."""
    if not len(ids):
        return 0.0
    shares = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(shares * np.log2(shares)).sum()) + 0.0


def judge_names(
    places: DataFrame, vocabulary: str, key: str = "place_id", name: str = "name", bands: dict[str, Band] | None = None
) -> DataFrame:
    """One row per place with its counts, the vocabulary's measures and the verdict.

    Columns: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, script,
    n_tokens, chars_per_token, byte_share, token_entropy, kept. Words are what ASCII white space
    separates. The base rule rejects texts of fewer than 10 words or with over 20 % repeated words; the
    bands of the script that most letters belong to reject what the vocabulary handles unlike language.
    A null name counts as empty: no words, so it is rejected; rows that repeat a key are judged one by one.
    """
    limits = bands or BANDS

    def judge(lists: Lists) -> Lists:
        known = per_worker(f"pieces {vocabulary}", lambda: Words(vocabulary))
        texts = [t or "" for t in lists["name"]]
        split = [t.encode().split() for t in texts]
        out: Lists = {n: [] for n in ("key", *COLUMNS)}
        for key_value, text, words, ids in zip(lists["key"], texts, split, known.encode(split)):
            chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
            repeats = repeated_words(words)
            failed = len(words) < FEW_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
            script = script_of(text)
            band, tokens = limits[script], len(ids)
            per_token = chars / tokens if tokens else 0.0
            bytes_share = float(known.is_byte[ids].mean()) if tokens else 0.0
            bits = entropy(ids)
            fits = (
                band.least_chars <= per_token <= band.most_chars
                and bytes_share <= band.most_byte_share
                and (tokens < band.entropy_tokens or bits >= band.least_entropy)
            )
            values = (
                len(words), chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text), repeats, failed,
                script, tokens, per_token, bytes_share, bits, not failed and fits,
            )
            out["key"].append(key_value)
            for column, value in zip(COLUMNS, values):
                out[column].append(value)
        return out

    kind = places.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return in_batches(named(places, key=key, name=name), judge, schema).withColumnRenamed("key", key)


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "script": "string", "n_tokens": "long", "chars_per_token": "double",
    "byte_share": "double", "token_entropy": "double", "kept": "boolean",
}
