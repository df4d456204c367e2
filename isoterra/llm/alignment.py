"""Tokens of two vocabularies side by side on place names, scored by inverted pair bitmaps.

Works on the places that `parse_geocoder` and `parse_pois` return: any key columns of the stored
response, `position` and `name`.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from isoterra.llm.batches import per_worker, slices
from isoterra.llm.tokens import byte_level, spelt
from isoterra.spread import cut, discard

PLACE = ("response_id", "position")
# Names of one container of bitmaps, by bytes and by number; a longer name is alone.
CONTAINER_BYTES, CONTAINER_NAMES = 8 << 20, 1 << 14
# A pair of ids is one number: first id times this plus second id.
PAIR = 1 << 31
# One space between two characters that are no white space: no token of either vocabulary reaches across it.
_PLACE = re.compile(r"(?<=\S)(?= \S)")
# Units in one call of a vocabulary.
CALL_UNITS = 500


class Ends:
    """Ids, byte starts and byte ends of the tokens of many units put one after the other, and tokens per unit."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        self.ids, self.counts, self.ends = ids, counts, np.cumsum(sizes[ids])
        self.starts = self.ends - sizes[ids]


class Vocabulary:
    """Token ids of units with their bytes."""

    def __init__(self, entries: Sequence[bytes]):
        self.bytes = list(entries)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.column = pa.array(self.bytes, pa.large_binary())

    def encode(self, text: str) -> Sequence[int]:
        """Ids of a space and the text."""
        raise NotImplementedError

    def tokens(self, calls: Sequence[Sequence[str]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, tokens per unit, which units the tokens spell with a space before); `lengths` are their bytes with it.

        The units of a call are encoded together with single spaces between; where the tokens spell the
        line, byte ends tell the units apart.
        """
        found = [self.encode(" ".join(units)) for units in calls]
        ids = np.array([i for f in found for i in f], np.int64)
        whole = "".join([f" {u}" for units in calls for u in units]).encode()
        if data_of(self.column.take(pa.array(ids))) == whole:
            return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(lengths), "right"), prepend=0), np.ones(len(lengths), bool)
        ids, counts, good, at = [], [], [], 0
        for units, one in zip(calls, found):
            own, one = lengths[at : at + len(units)], np.array(one, np.int64)
            at += len(units)
            if data_of(self.column.take(pa.array(one))) == b" " + " ".join(units).encode():
                ids.append(one)
                counts.append(np.diff(np.searchsorted(np.cumsum(self.sizes[one]), np.cumsum(own), "right"), prepend=0))
                good.append(np.ones(len(units), bool))
                continue
            for unit in units:
                one = self.encode(unit)
                right = b"".join([self.bytes[i] for i in one]) == b" " + unit.encode()
                ids.append(np.array(one if right else [], np.int64))
                counts.append(np.array([len(one) * right]))
                good.append(np.array([right]))
        return np.concatenate(ids), np.concatenate(counts), np.concatenate(good)


class ByteLevel(Vocabulary):
    """A vocabulary file of the tokenizers library that writes bytes as characters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        found = [b""] * (max(entries.values()) + 1)
        for entry, n in entries.items():
            found[n] = spelt(entry)
        super().__init__(found)
        self.quick = byte_level(self.tokenizer)

    def encode(self, text: str) -> Sequence[int]:
        if self.quick is not None:
            return self.quick.encode_ordinary(" " + text)
        return self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class Pieces(Vocabulary):
    """A sentence-piece model that puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__([self._spelt(n) for n in range(self.model.get_piece_size())])

    def _spelt(self, n: int) -> bytes:
        piece = self.model.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(n) else piece.replace("\u2581", " ").encode()

    def encode(self, text: str) -> Sequence[int]:
        return self.model.encode(text)


def vocabularies(first: str, second: str) -> tuple[Vocabulary, Vocabulary]:
    """The two vocabularies that this Python worker keeps."""
    return per_worker(f"aligned {first} {second}", lambda: (ByteLevel(first), Pieces(second)))


def data_of(column: pa.LargeBinaryArray) -> bytes:
    """The values of a column, one after the other."""
    ends = offsets(column)
    return column.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes() if len(column) else b""


def offsets(column: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def edged(unit: str) -> bool:
    """Whether a unit is empty or has white space at an end."""
    return not unit or unit[0].isspace() or unit[-1].isspace()


def units(names: Sequence[str | None]) -> tuple[list[list[str]], list[list[str]]]:
    """The parts of names between which no token reaches, without the space before them, and all distinct ones by calls.

    Null and empty names have no parts. A part that is empty or has white space at an end is a call alone.
    """
    split = [name.split(" ") if name else [] for name in names]
    distinct = set().union(*split)
    odd = {u for u in distinct if edged(u)}
    if odd:
        for n, name in enumerate(names):
            if not odd.isdisjoint(split[n]):
                first, *rest = _PLACE.split(name)
                split[n] = [first, *[u[1:] for u in rest]]
        distinct = set().union(*split)
        odd = {u for u in distinct if edged(u)}
    even = list(distinct - odd)
    return split, [*[even[at : at + CALL_UNITS] for at in range(0, len(even), CALL_UNITS)], *[[u] for u in odd]]


def overlaps(a: Ends, b: Ends) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all tokens of `a` and `b` whose byte ranges overlap, by `a` and then `b`."""
    first = np.searchsorted(b.ends, a.starts, "right")
    count = np.searchsorted(b.starts, a.ends, "left") - first
    left = np.repeat(np.arange(len(a.ids)), count)
    return left, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class Aligned:
    """Groups and links of distinct units: row n describes unit n, and a unit without tokens has none."""

    def __init__(self, first: Vocabulary, second: Vocabulary, calls: Sequence[Sequence[str]]):
        distinct = [u for c in calls for u in c]
        lengths = np.array([len(u.encode()) + 1 for u in distinct], np.int64)
        found, others = first.tokens(calls, lengths), second.tokens(calls, lengths)
        self.good = found[2] & others[2]
        a, b = (Ends(ids[np.repeat(self.good, counts)], counts[self.good], v.sizes) for v, (ids, counts, _) in ((first, found), (second, others)))
        both = np.intersect1d(a.ends, b.ends, assume_unique=True)
        kept = np.flatnonzero(self.good)
        size = len(distinct)

        def spread(values: np.ndarray) -> np.ndarray:
            out = np.zeros(size, np.int64)
            out[kept] = values
            return out

        self.n_first, self.n_second = spread(a.counts), spread(b.counts)
        unit_ends = a.ends[np.cumsum(a.counts) - 1] if len(kept) else a.ends
        at = np.searchsorted(both, unit_ends, "right")
        self.n_groups = spread(np.diff(at, prepend=0))
        left, right = overlaps(a, b)
        self.pairs = a.ids[left] * PAIR + b.ids[right]
        owner = np.searchsorted(unit_ends, a.ends[left], "left")
        self.n_links = spread(np.bincount(owner, minlength=len(kept)))
        self.links_from = np.cumsum(self.n_links) - self.n_links
        # Groups as text: the tokens of either side up to each common end, a mark after each.
        sides, order = [np.searchsorted(both, x.ends, "left") for x in (a, b)], np.zeros(len(a.ids) + len(b.ids), np.int64)
        ends = [np.searchsorted(x.ends, both, "right") for x in (a, b)]
        last = [np.isin(np.arange(len(x.ids)) + 1, e) for x, e in zip((a, b), ends)]
        order[np.arange(len(a.ids)) + np.concatenate([[0], ends[1]])[sides[0]]] = a.ids * 2 + last[0]
        order[np.arange(len(b.ids)) + ends[0][sides[1]]] = (b.ids + len(first.bytes)) * 2 + last[1]
        told = pa.array(
            [f"{n}{mark}".encode() for v, marks in ((first, ",|"), (second, ",;")) for n in range(len(v.bytes)) for mark in marks], pa.large_binary()
        ).take(pa.array(order))
        # A unit's text is that of its tokens.
        edges = np.concatenate([[0], np.cumsum(self.n_first + self.n_second)])
        self.text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(offsets(told)[edges].copy()), told.buffers()[2]])


def postings(name: np.ndarray, pair: np.ndarray, count: np.ndarray, names: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, list]]:
    """Bitmaps (pairs, planes, form, data) of entries sorted by pair and name.

    Plane 0 of a pair has a bit for every name with it, plane n the names whose further links have bit
    n - 1 in their number. Few bits are listed as 16-bit places (form 0), many are a plain bitmap (form 1).
    """
    plane, more = 0, count - 1
    at = np.arange(len(pair))
    while len(at):
        rows, keys = name[at], pair[at]
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        sizes = np.diff(starts, append=len(keys))
        dense = sizes * 16 > names
        data = rows.astype("<u2").tobytes()
        few = np.flatnonzero(~dense)
        edges = zip((2 * starts[few]).tolist(), (2 * (starts + sizes)[few]).tolist())
        yield keys[starts[few]], np.full(len(few), plane, np.int8), 0, [data[b:e] for b, e in edges]
        full = np.flatnonzero(dense)
        for part in np.array_split(full, max(1, len(full) * names // (1 << 23))):
            bits = np.zeros((len(part), names), np.uint8)
            bits[np.repeat(np.arange(len(part)), sizes[part]), rows[_ranges(starts[part], sizes[part])]] = 1
            yield keys[starts[part]], np.full(len(part), plane, np.int8), 1, [x.tobytes() for x in np.packbits(bits, axis=1)]
        plane += 1
        at = np.flatnonzero(more >> (plane - 1) & 1) if (more >> (plane - 1)).any() else at[:0]
        while not len(at) and (more >> (plane - 1)).any():
            plane += 1
            at = np.flatnonzero(more >> (plane - 1) & 1)


def bits_of(form: int, data: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row of data, place) of every set bit."""
    sizes = np.array([len(d) for d in data], np.int64)
    if form == 0:
        return np.repeat(np.arange(len(data)), sizes // 2), np.frombuffer(b"".join(data), "<u2").astype(np.int64)
    out = [np.flatnonzero(np.unpackbits(np.frombuffer(d, np.uint8))) for d in data]
    return np.repeat(np.arange(len(data)), [len(x) for x in out]), np.concatenate(out) if out else np.zeros(0, np.int64)


POSTING = "container long, pair long, plane byte, form byte, bits binary"
COUNTS = "place long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose rows are one container each."""
    held, size, names = [], 0, 0
    for batch in batches:
        for part in slices(batch):
            for at in range(0, part.num_rows, CONTAINER_NAMES):
                some = part.slice(at, CONTAINER_NAMES)
                if held and (size + some.nbytes > CONTAINER_BYTES or names + some.num_rows > CONTAINER_NAMES):
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size, names = [], 0, 0
                held.append(some)
                size, names = size + some.nbytes, names + some.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def align(names: Sequence[str | None], first: Vocabulary, second: Vocabulary) -> tuple[dict[str, list], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """COUNTS columns of names but for `place`, and (name, pair, links), sorted by pair and name."""
    split, calls = units(names)
    distinct = [u for c in calls for u in c]
    number = {u: n for n, u in enumerate(distinct)}
    aligned = Aligned(first, second, calls)
    parts = [list(map(number.__getitem__, s)) for s in split]
    flat = np.array([n for p in parts for n in p], np.int64)
    owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    # One unit without tokens leaves the whole name without.
    bad = np.zeros(len(names), bool)
    bad[owner[~aligned.good[flat]]] = True
    bad |= np.array([not p for p in parts], bool)
    flat, owner = flat[~bad[owner]], owner[~bad[owner]]

    def total(values: np.ndarray) -> list[int]:
        out = np.zeros(len(names), np.int64)
        np.add.at(out, owner, values[flat])
        return out.tolist()

    told = aligned.text.take(pa.array(flat))
    ends = offsets(told)[np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(names)))])].tolist()
    data = memoryview(told.buffers()[2]) if len(flat) else b""
    # The last mark of a name goes.
    digests = ["" if e == b else hashlib.sha256(data[b : e - 1]).hexdigest() for b, e in zip(ends, ends[1:])]
    counts = {"n_a": total(aligned.n_first), "n_b": total(aligned.n_second), "n_groups": total(aligned.n_groups), "n_links": total(aligned.n_links)}
    # Units of a name, then their pairs: each is counted once and repeated as often as it occurs.
    met, times = np.unique(owner * max(1, len(distinct)) + flat, return_counts=True)
    where, unit = met // max(1, len(distinct)), met % max(1, len(distinct))
    size = aligned.n_links[unit]
    pairs, place = np.unique(aligned.pairs, return_inverse=True)
    place = place[_ranges(aligned.links_from[unit], size)]
    entry, back = np.unique(place * len(names) + np.repeat(where, size), return_inverse=True)
    links = np.zeros(len(entry), np.int64)
    np.add.at(links, back, np.repeat(times, size))
    return counts | {"groups_sha256": digests}, (entry % max(1, len(names)), pairs[entry // max(1, len(names))], links)


def indexed_names(places: DataFrame, first: str, second: str, keys: Sequence[str] = PLACE, name: str = "name") -> DataFrame:
    """The written index: a row per place (keys, COUNTS) and a row per bitmap (POSTING), the others' columns null.

    Places are numbered by task and row, and what a task reads at a time is a container: the upper bits
    of `place` are the container and the lower 14 the place in its bitmaps.
    """
    rows = places.select(*[places[k].alias(f"key{n}") for n, k in enumerate(keys)], places[name].cast("string").alias("name"))
    fields = [f for f in rows.schema.fields if f.name != "name"]
    counts, posting = StructType.fromDDL(COUNTS).fields, StructType.fromDDL(POSTING).fields
    schema = StructType([*[type(f)(f.name, f.dataType) for f in fields], *counts, *posting])
    kinds = to_arrow_schema(schema)

    def filled(columns: dict[str, pa.Array], size: int) -> pa.RecordBatch:
        arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds]
        return pa.RecordBatch.from_arrays(arrays, schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = vocabularies(first, second), TaskContext.get().partitionId()
        for n, batch in enumerate(_containers(batches)):
            container = task << 24 | n
            columns, (name_at, pair, links) = align(batch.column("name").to_pylist(), *held)
            made = {k: pa.array(v, kinds.field(k).type) for k, v in columns.items()}
            made |= {f.name: batch.column(f.name) for f in fields}
            yield filled(made | {"place": pa.array(np.arange(batch.num_rows) + (container << 14))}, batch.num_rows)
            for keys_, planes, form, data in postings(name_at, pair, links, batch.num_rows):
                size = len(keys_)
                told = {"container": pa.array(np.full(size, container)), "pair": pa.array(keys_), "plane": pa.array(planes)}
                yield filled(told | {"form": pa.array(np.full(size, form, np.int8)), "bits": pa.array(data, pa.binary())}, size)

    return cut(rows.mapInArrow(run, schema))


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, first_id, second_id, names, links) over all containers.

    Containers hold different places, so the union of a pair's bitmaps is their list and its size the
    sum of their set bits; bits of plane n above 0 stand for 2 ** (n - 1) links each.
    """
    bits = F.when(F.col("form") == 0, F.octet_length("bits") / 2).otherwise(F.bitmap_count("bits")).cast("long")
    plane = F.col("plane").cast("int")
    weight = F.when(plane == 0, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(plane - 1, F.lit(0))))
    counted = index.where("pair is not null").groupBy("pair").agg(
        F.sum(F.when(plane == 0, bits).otherwise(0)).alias("names"), F.sum(bits * weight).alias("links")
    )
    pair = F.col("pair")
    return counted.select("pair", F.floor(pair / PAIR).alias("first_id"), F.pmod(pair, F.lit(PAIR)).alias("second_id"), "names", "links")


def _return_scores(postings: pa.Table) -> pa.Table:
    """Sums over the bitmaps of one container: a set bit gives its place the pair's count and whether that is the best one."""
    best, total = (np.zeros(CONTAINER_NAMES, np.int64) for _ in range(2))
    container = postings.column("container")[0].as_py()
    form, plane = postings.column("form").to_numpy(), postings.column("plane").to_numpy().astype(np.int64)
    links, is_best = postings.column("links").to_numpy(), postings.column("is_best").to_numpy(zero_copy_only=False)
    bits = postings.column("bits").combine_chunks()
    weight = 1 << np.maximum(plane - 1, 0)
    for kind in (0, 1):
        rows = np.flatnonzero(form == kind)
        row, place = bits_of(kind, bits.take(pa.array(rows)).to_pylist())
        np.add.at(total, place, (weight * links)[rows][row])
        np.add.at(best, place, (weight * is_best)[rows][row])
    kept = np.flatnonzero(total)
    return pa.table({"place": kept + (container << 14), "n_best": best[kept], "count_sum": total[kept]})


def aligned_names(places: DataFrame, first: str, second: str, keys: Sequence[str] = PLACE, name: str = "name") -> DataFrame:
    """How the tokens of two vocabularies cover each place's name, with scores from all names.

    Returns the keys, n_a, n_b (tokens), n_groups (stretches between common ends), n_links (pairs of
    tokens whose bytes overlap), n_best (links whose pair is linked most often of all pairs with its
    second id, ties included), count_sum (over the links, how often their pair is linked in all names)
    and groups_sha256. `first` is a byte-level vocabulary file, applied to a space and the name, `second`
    a sentence-piece one that puts the space there itself. Strings of special tokens are plain text.

    Names are encoded once. For every pair of ids, bitmaps say which names of a container of up to
    16,384 hold it, further planes how often; their set bits are the counts, and the bitmaps, with
    the counts of their pairs, give the scores back to the names.

    A null or empty name, and one whose tokens do not spell a space and the name, has no tokens: zeros
    and an empty digest. Rows that repeat a key each get a row and count each; an empty table gives no
    rows; keys can have any type, and other columns are ignored; a very long name is a container alone.
    """
    index = indexed_names(places, first, second, keys, name)
    pairs = cut(pair_counts(index))
    most = pairs.groupBy("second_id").agg(F.max("links").alias("_most"))
    scores = pairs.join(most.hint("merge"), "second_id").select("pair", "links", (F.col("links") == F.col("_most")).cast("long").alias("is_best"))
    found = index.where("pair is not null").select("container", "pair", "plane", "form", "bits")
    scored = found.join(scores.hint("merge"), "pair").select("container", "plane", "form", "bits", "links", "is_best")
    returned = cut(scored.groupBy("container").applyInArrow(_return_scores, "place long, n_best long, count_sum long"))
    discard(pairs)
    told = index.where("place is not null").join(returned.hint("merge"), "place", "left")
    return told.select(
        *[F.col(f"key{n}").alias(k) for n, k in enumerate(keys)], "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
