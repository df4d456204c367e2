"""Token ids of whole texts with a public vocabulary, frequent chunks encoded once.

A text is cut where one space stands between two characters that are no white space. Neither of the
two kinds of public vocabulary has a token across such a place: byte-level splitting starts a new
piece at that space, word splitting drops it. So the ids of the chunks, put together, are the ids of
the text, and a chunk that was met before costs a dictionary lookup.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np

from isoterra.llm.batches import per_worker

# Distinct chunks in one generation; a worker keeps two generations.
KEPT = 400_000
_PLACE = re.compile(r"(?<=\S)(?= \S)")
_MARKS = ".,;:|!?"
# Stands between words in one call of the library: how byte 0 is written, which no word has.
_BETWEEN = "\u0100"
_CALL = 20_000
# Letters below this one are composed, lower-case alike everywhere and count as letters for both vocabularies.
_LATIN_END = "\u0250"
# Printable ASCII, Latin and general punctuation without white space: composed already, and lower-cased and split alike everywhere.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\u024f\u2010-\u2027\u2030-\u205e]+")
# How byte-level vocabularies write bytes: visible Latin-1 characters stand for themselves, the others follow U+0100 in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_WRITTEN = {b: b for b in _SHOWN} | {b: 256 + n for n, b in enumerate(_HIDDEN)}
_BYTE = {chr(c): b for b, c in _WRITTEN.items()}


# Ends a word in a call of the faster library; words of letters do not hold it.
_END, _WORD_END = "\x01", "</w>"


def spelt(entry: str) -> bytes:
    """The bytes of a vocabulary entry that writes bytes as characters."""
    return bytes(_BYTE.get(c, 0) for c in entry) if all(c in _BYTE for c in entry) else entry.encode()


def byte_level(tokenizer):
    """The same vocabulary in a faster library, or None where its splits or the order of its merges do not allow that.

    The faster library merges by ascending id, so the merges have to be listed in that order.
    """
    import public_tokenizers
    import tiktoken

    model, entries = json.loads(tokenizer.to_str()), tokenizer.get_vocab(with_added_tokens=True)
    pieces, special = model["pre_tokenizer"] or {}, {t["id"] for t in model["added_tokens"]}
    usual = model["normalizer"] is None and pieces.get("type") == "ByteLevel" and pieces.get("use_regex") and not pieces.get("add_prefix_space")
    if not usual or not _merges_ascend(model, entries):
        return None
    ranks = {spelt(e): n for e, n in entries.items() if n not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _merges_ascend(model: dict, entries: dict[str, int]) -> bool:
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    ids = [entries.get(a + b, -1) for a, b in merges]
    return bool(ids) and ids == sorted(ids) and ids[0] >= 0


def word_ends(tokenizer):
    """The merges of a vocabulary with word ends in a faster library, for words each followed by _END; None as above.

    An entry that ends a word is its bytes and _END. The last byte of a word and _END are joined before
    anything else, because the single bytes with a word end come before all merges.
    """
    import tiktoken

    model, entries = json.loads(tokenizer.to_str()), tokenizer.get_vocab(with_added_tokens=True)
    if model["model"].get("end_of_word_suffix") != _WORD_END or not _merges_ascend(model, entries):
        return None
    special = {t["id"] for t in model["added_tokens"]}
    ranks, ends = {}, np.zeros(max(entries.values()) + 1, bool)
    for entry, n in entries.items():
        if n in special:
            continue
        ends[n] = entry.endswith(_WORD_END)
        ranks[spelt(entry.removesuffix(_WORD_END)) + (_END.encode() if ends[n] else b"")] = n
    first = min(n for e, n in entries.items() if len(spelt(e.removesuffix(_WORD_END))) > 1 and n not in special)
    singles = [n for e, n in entries.items() if e.endswith(_WORD_END) and len(spelt(e.removesuffix(_WORD_END))) == 1]
    if max(singles) > first:
        return None
    pattern = _split_pattern(model)
    if pattern is None:
        return None
    return tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}), ends, pattern


def _split_pattern(model: dict):
    """The pattern whose matches are the pieces of a text, if that and lower-casing is all that happens to printable ASCII."""
    import regex

    kinds = [n["type"] for n in (model["normalizer"] or {}).get("normalizers", [])]
    first, *rest = (model["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    usual = kinds == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    usual = usual and [r["type"] for r in rest] == ["ByteLevel"] and not rest[0]["use_regex"] and not rest[0]["add_prefix_space"]
    return regex.compile(first["pattern"]["Regex"]) if usual else None


def _latin(word: str) -> bool:
    """Whether a word is of Latin letters that are composed and keep their number in lower case."""
    return word.isalpha() and (word.isascii() or (max(word) < _LATIN_END and len(word.lower()) == len(word)))


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Strings of special tokens inside a text are ordinary text. Chunks that were not met for long leave
    the memory: when a generation is full it becomes the older one, and what is met again moves on.
    """

    def __init__(self, vocabulary: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        # A byte-level vocabulary takes whole texts at once, one with word ends many words.
        self.quick, self.marked = byte_level(self.tokenizer), word_ends(self.tokenizer)
        # Chunk without the space before it -> ids; None for a chunk with white space at an end.
        self.kept, self.older, self.newer = kept, {}, {}
        # How the vocabulary writes a word after a space: what stands for the space, and whether case is kept.
        normalizer = self.tokenizer.normalizer
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normalizer.normalize_str(" A") if normalizer else " A")
        self.prefix, self.lower = pieces[-1][0].rstrip("aA"), pieces[-1][0].endswith("a")
        # The same merges on pieces that are already split, many in one call with a byte between that no word has.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split(_BETWEEN, "isolated")
        (self.between,) = self.merges.encode(_BETWEEN, add_special_tokens=False).ids

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: Sequence[str]) -> dict[str, bytes]:
        """Ids of words of Latin letters after a space."""
        cased = [w.lower() for w in words] if self.lower else words
        known = {}
        for start in range(0, len(words), _CALL):
            some = cased[start : start + _CALL]
            written = [w if w.isascii() else w.encode().decode("latin-1").translate(_WRITTEN) for w in some]
            line = (_BETWEEN + self.prefix).join(["", *written])[1:] + _BETWEEN
            ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            ends, data = (np.flatnonzero(ids == self.between) * 4).tolist(), ids.tobytes()
            begins = [0, *[e + 4 for e in ends]]
            known.update(zip(words[start : start + _CALL], [data[b:e] for b, e in zip(begins, ends)]))
        return known

    def _learn_pieces(self, missing: set[str]) -> None:
        """As `_learn`: chunks are split into pieces here, and the faster library merges the pieces of many chunks at once."""
        library, is_end, pattern = self.marked
        older, newer, split = self.older, self.newer, pattern.findall
        chunks, pieces, counts, odd = [], [], [], []
        for chunk in missing:
            if chunk in older:
                newer[chunk] = older[chunk]
                continue
            if _latin(chunk):
                found = [chunk.lower()]
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                newer[chunk] = None
                continue
            elif _PLAIN.fullmatch(chunk) and len(chunk.lower()) == len(chunk):
                found = split(chunk.lower())
            else:
                odd.append(chunk)
                continue
            chunks.append(chunk)
            pieces += found
            counts.append(len(found))
        for start in range(0, len(odd), _CALL):
            some = odd[start : start + _CALL]
            told = self.tokenizer.encode_batch_fast([" " + c for c in some], add_special_tokens=False)
            newer.update(zip(some, [np.array(t.ids, "<u4").tobytes() for t in told]))
        # Every piece ends with the one token that ends a word.
        ids = [np.array(library.encode_ordinary(_END.join([*pieces[at : at + _CALL], ""])), "<u4") for at in range(0, len(pieces), _CALL)]
        ids = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        ends = ((np.flatnonzero(is_end[ids]) + 1) * 4)[np.cumsum(counts, dtype=np.int64) - 1].tolist() if chunks else []
        data = ids.tobytes()
        newer.update(zip(chunks, [data[b:e] for b, e in zip([0, *ends], ends)]))

    def _learn(self, missing: set[str]) -> None:
        if self.marked is not None:
            self._learn_pieces(missing)
            return
        simple, odd, marks = [], [], {"": b""}
        for chunk in missing:
            if chunk in self.older:
                self.newer[chunk] = self.older[chunk]
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                self.newer[chunk] = None
            else:
                word = chunk.rstrip(_MARKS)
                if word.isalpha() and max(word) < _LATIN_END and len(word.lower()) == len(word):
                    simple.append((chunk, word))
                else:
                    odd.append(chunk)
        for start in range(0, len(odd), _CALL):
            some = odd[start : start + _CALL]
            found = self.tokenizer.encode_batch_fast([" " + c for c in some], add_special_tokens=False)
            self.newer.update(zip(some, [np.array(f.ids, "<u4").tobytes() for f in found]))
        # Letters and the marks after them are pieces of their own.
        words = self._words(list({w for _, w in simple}))
        for chunk, word in simple:
            tail = chunk[len(word) :]
            if tail not in marks:
                marks[tail] = self._library(tail)
            self.newer[chunk] = words[word] + marks[tail]

    def _careful(self, text: str) -> bytes:
        return b"".join([self._library(c) for c in _PLACE.split(text)])

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of every whole text; null and empty texts have none."""
        if self.quick is not None:
            return [np.array(self.quick.encode_ordinary(text), "<u4").tobytes() if text else b"" for text in texts]
        if len(self.newer) > self.kept:
            self.older, self.newer = self.newer, {}
        split = [text.split(" ") if text else [] for text in texts]
        self._learn(set().union(*split).difference(self.newer))
        found, out = self.newer.__getitem__, []
        for text, chunks in zip(texts, split):
            try:
                if chunks and found(chunks[0]) is None:
                    out.append(self._careful(text))
                    continue
                out.append((self._library(chunks[0]) if chunks else b"") + b"".join(map(found, chunks[1:])))
            except TypeError:  # a None among the chunks
                out.append(self._careful(text))
        return out


def encoder(vocabulary: str) -> Encoder:
    """The encoder that this Python worker keeps for a vocabulary file."""
    return per_worker(f"encoder {vocabulary}", lambda: Encoder(vocabulary))
