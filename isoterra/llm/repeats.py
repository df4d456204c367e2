"""Byte runs that exported map documents repeat, found by suffix sorting.

Works on the library's exported documents (export_id, value): GeoJSON, SVG or mesh text, one row per
document. A byte goes if a string of `length` bytes that covers it also starts earlier, in a document
of smaller id or further up in the same one; the strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoterra.llm.batches import per_worker, slices
from isoterra.llm.induced import Space, suffix_array
from isoterra.spread import cut

LENGTH = 100
# Bytes of the anchors that decide which shard a string belongs to.
ANCHOR = 24
# Bytes that one shard should have; more bytes make more shards.
SHARD_BYTES = 3 << 20
# Bytes of texts that are scanned together; a longer text is scanned alone.
SCAN_BYTES = 1 << 20
# Odd multipliers that mix the words of an anchor.
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), "<u8", padded, 0, (1,)).copy()


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every `width` values in a row, by doubling."""
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, kept by the worker."""

    def make() -> list:
        return [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]

    held = per_worker("powers", make)
    if len(held[0]) < count:
        size = 1 << int(count).bit_length()
        base = int(_MIX[0])
        for n, b in enumerate((base, pow(base, -1, 1 << 64))):
            held[n] = np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64)
    return held[0][:count], held[1][:count]


def anchors(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, hash, context, first, count) per anchor of texts that are scanned together.

    The anchor of a string of `length` bytes is its substring of `anchor` bytes with the smallest hash, the
    leftmost of equal ones, so equal strings have equal anchors wherever they stand. Strings in a row
    mostly share an anchor; `first` is where the first of them starts in its text, `count` their number.
    `context` is a digest of all bytes under these strings.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    empty = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return empty, empty, empty, empty, empty
    eight = words_at(data)
    usable = len(data) - anchor + 1
    mixed = sum(eight[8 * n : 8 * n + usable] * _MIX[n] for n in range(anchor // 8))
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[3]
    mixed ^= mixed >> np.uint64(32)
    # The place in the low bits makes the leftmost of equal hashes the smallest and tells where it is.
    bits = np.uint64(max(1, int(usable).bit_length()))
    placed = (mixed >> bits << bits) | np.arange(usable, dtype=np.uint64)
    chosen = (_window_minimum(placed, length - anchor + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    starts = np.arange(len(chosen))
    text = np.searchsorted(begins, starts, "right") - 1
    inside = starts + length <= (begins + sizes)[text]
    starts, text, chosen = starts[inside], text[inside], chosen[inside]
    if not len(starts):
        return empty, empty, empty, empty, empty
    new = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))
    count = np.diff(np.append(new, len(starts)))
    # The digest adds up mixed words with powers of their place, so every stretch has its own by subtraction.
    up, down = _powers(usable)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * up, dtype=np.uint64)])
    low, high = starts[new], starts[new] + count + length - anchor
    context = (sums[high] - sums[low]) * down[low] + count.astype(np.uint64) * _MIX[1]
    return text[new], mixed[chosen[new]].view(np.int64), context.view(np.int64), (starts - begins[text])[new], count


def _groups(texts: list[bytes], limit: int) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= limit):
            held += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _ranks(ids: list, marks: list) -> np.ndarray:
    """Places of documents in their order, equal for equal ones; those without an id come first."""
    keys = list(zip(ids, marks))
    ordered = sorted(set(keys), key=lambda k: (k[0] is not None, k[0] if k[0] is not None else 0, k[1]))
    numbers = dict(zip(ordered, range(len(ordered))))
    return np.array([numbers[k] for k in keys])


def _seen_together(anchor: np.ndarray, context: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places of one scan have an earlier place with their context, and which have company at their anchor."""
    order = np.lexsort((place, rank, context, anchor))
    a, c, k = anchor[order], context[order], np.arange(len(order))
    other_anchor = np.append(True, a[1:] != a[:-1])
    new = other_anchor | np.append(True, c[1:] != c[:-1])
    first = order[np.maximum.accumulate(np.where(new, k, 0))]
    again, met = np.zeros(len(order), bool), np.zeros(len(order), bool)
    # A row that is listed twice is no earlier place of itself.
    again[order] = ~new & ((rank[order] != rank[first]) | (place[order] != place[first]))
    met[order] = ~other_anchor | np.append(~other_anchor[1:], False)
    return again, met


def repeated_strings(
    contexts: list[bytes], owned: np.ndarray, rank: np.ndarray, length: int = LENGTH, in_memory: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of strings that start earlier in another place of the shard.

    The first `owned` places of a context start strings of `length` bytes that belong to this shard;
    `rank` orders the contexts. After the suffix sort equal strings are neighbours; in a run of
    neighbours with a common prefix of `length` bytes all but the earliest are repeated.
    """
    count = len(contexts)
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    # Every context ends with a symbol of its own, smaller than all bytes, the last one with 0.
    places = np.arange(len(data)) + np.repeat(np.arange(count), sizes)
    ends = begins + sizes + np.arange(count)
    with Space(in_memory) if in_memory is not None else Space() as space:
        text = space.full(len(data) + count, np.int32, 0)
        text[places] = data.astype(np.int32) + count
        text[ends] = np.arange(count)[::-1]
        order = suffix_array(text, count + 256, space)
        context = np.searchsorted(ends, order)
        offset = order - (begins + np.arange(count))[context]
        mine = offset < owned[context]
        context, offset = context[mine], offset[mine]
    spots = begins[context] + offset
    words = words_at(data)
    alike = np.arange(1, len(spots))
    for n in [*range(0, length - 8, 8), length - 8]:
        alike = alike[words[spots[alike] + n] == words[spots[alike - 1] + n]]
    joined = np.zeros(len(spots), bool)
    joined[alike] = True
    value = rank[context] * np.int64(1 << 32) + offset
    runs = np.flatnonzero(~joined)
    if not len(runs):
        return context[:0], offset[:0]
    smallest = np.repeat(np.minimum.reduceat(value, runs), np.diff(np.append(runs, len(spots))))
    again = value != smallest
    return context[again], offset[again]


def _spans(context: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the bytes under strings, strings in a row joined."""
    order = np.lexsort((offset, context))
    context, offset = context[order], offset[order]
    new = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)))
    last = np.append(new[1:], len(offset)) - 1
    return context[new], offset[new], offset[last] + length


def repeated_runs(
    exports: DataFrame, export_id: str = "export_id", value: str = "value", length: int = LENGTH, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Strings can only be equal if their anchors are, so the work is shared out by anchor. Anchors and a
    digest of their contexts (both 64 bits wide) are sorted first: an anchor that occurs once is done; of
    occurrences with equal context only the earliest goes on, and the strings of the others are all
    repeated. A scan tells its own repetitions apart beforehand, so a hot anchor sends few rows. The contexts that go on are sent to the shard of their anchor, and every shard is sorted by
    external induced sorting (`induced`), which tells the strings that differing contexts share. The
    number of shards follows the bytes to sort. A task gathers its whole shard in memory and holds it there
    several times over; only the text, the slots and the result of the sort become files when large. As an
    anchor is never split, one whose contexts differ in more bytes than that does not fit. Common prefixes are measured between final neighbours instead of being carried through the
    sort: only `length` bytes count here, and comparing those costs less than carrying them.

    A null text counts as empty. Rows that repeat an id are ordered by a hash of their texts; if the
    texts are equal too, the rows are one document that is listed as often as it occurs. Rows without an
    id come first. An empty table gives no rows.
    """
    kind = exports.schema[export_id].dataType.simpleString()
    text = F.coalesce(F.col(value), F.lit(""))
    known = exports.select(F.col(export_id).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            ids, marks = batch.column("id"), batch.column("mark")
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for at, some in _groups(texts, SCAN_BYTES):
                number, hashes, context, first, count = anchors(some, length)
                if len(number):
                    rank = _ranks(ids.slice(at, len(some)).to_pylist(), marks.slice(at, len(some)).to_pylist())[number]
                    place = first * 256 + count
                    again, met = _seen_together(hashes, context, rank, place)
                    take = pa.array(number + at)
                    columns = [pa.array(hashes), pa.array(context), ids.take(take), marks.take(take), pa.array(place), pa.array(again), pa.array(met)]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "id", "mark", "place", "again", "met"])

    places = known.mapInArrow(scan, f"anchor long, context long, id {kind}, mark long, place long, again boolean, met boolean")
    # Neighbours in the order of an anchor tell whether a place is the first of its context and alone.
    # Places that the scan itself has seen again are spread evenly: of a hot anchor, only one place per
    # context and scan remains in its group.
    spread = F.when(F.col("again"), F.xxhash64("id", "mark", "place")).otherwise(F.lit(0).cast("long"))
    order = Window.partitionBy("anchor", spread).orderBy("context", "id", "mark", "place")
    same_row = F.lag("id").over(order).eqNullSafe(F.col("id")) & (F.lag("mark").over(order) == F.col("mark")) & (F.lag("place").over(order) == F.col("place"))
    again = F.col("again") | F.coalesce((F.lag("context").over(order) == F.col("context")) & ~same_row, F.lit(False))
    alone = ~F.col("met") & F.lag("place").over(order).isNull() & F.lead("place").over(order).isNull()
    told = places.select("id", "mark", "place", again.alias("again"), alone.alias("alone")).where("not alone")
    # Of a place the list keeps 2 * place, plus one if its context has to be sorted.
    listed = F.col("place") * 2 + (~F.col("again")).cast("long")
    chosen = cut(told.groupBy("id", "mark").agg(F.collect_list(listed).alias("places")))
    size = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + (p % 2) * (F.shiftright(p, 1) % 256 + length - 1))
    to_sort = chosen.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    shards = to_sort // shard_bytes + 1

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                places = batch.column("places")[n].values.to_numpy()
                wanted = places[places % 2 == 1] >> 1
                if not len(wanted):
                    continue
                data = batch.column("text")[n].as_py().encode()
                _, hashes, _, first, count = anchors([data], length)
                mine = np.flatnonzero(np.isin(first * 256 + count, wanted))
                for at in range(0, len(mine), 4096):
                    some = mine[at : at + 4096]
                    pieces = [data[f : f + c + length - 1] for f, c in zip(first[some].tolist(), count[some].tolist())]
                    take = pa.array(np.full(len(some), n))
                    columns = [pa.array(hashes[some]), batch.column("id").take(take), batch.column("mark").take(take), pa.array(first[some]), pa.array(pieces, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "mark", "first", "context"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        # Contexts with an anchor of their own have no string in common with any other.
        _, which, times = np.unique(table.column("anchor").to_numpy(), return_inverse=True, return_counts=True)
        table = table.filter(pa.array(times[which] > 1))
        if not table.num_rows:
            return
        pieces = table.column("context").to_pylist()
        held = np.array([len(p) - length + 1 for p in pieces])
        firsts = table.column("first").to_numpy()
        rank = _ranks(table.column("id").to_pylist(), table.column("mark").to_pylist()) * (int(firsts.max()) + 1) + firsts
        rank = np.unique(rank, return_inverse=True)[1]
        context, offset = repeated_strings(pieces, held, rank, length)
        if not len(context):
            return
        context, start, end = _spans(context, offset, length)
        take = pa.array(context)
        base = table.column("first").to_numpy()[context]
        out = [table.column("id").take(take), table.column("mark").take(take), pa.chunked_array([pa.array(base + start)]), pa.chunked_array([pa.array(base + end)])]
        yield from pa.table(out, names=["id", "mark", "start", "end"]).to_batches()

    def joined(texts: DataFrame, side: DataFrame, column: str, how: str) -> DataFrame:
        other = side.withColumnsRenamed({"id": "_id", "mark": "_mark"})
        on = texts["id"].eqNullSafe(other["_id"]) & (texts["mark"] == other["_mark"])
        return texts.join(other, on, how).select(*texts.columns, column)

    located = joined(known, chosen, "places", "left")
    around = located.where("places is not null").mapInArrow(contexts, f"anchor long, id {kind}, mark long, first long, context binary")
    found = around.repartition(int(shards), "anchor").mapInArrow(sort, f"id {kind}, mark long, start long, end long")
    spans = found.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for body, places, shared in zip(*[batch.column(c).to_pylist() for c in ("text", "places", "spans")]):
                data, at, kept, runs = body.encode(), 0, [], 0
                whole = [(p >> 9, (p >> 9) + (p >> 1) % 256 + length - 1) for p in places or [] if p % 2 == 0]
                for start, end in sorted(whole + [(s["start"], s["end"]) for s in shared or []]):
                    if start > at or not runs:
                        kept.append(data[at:start])
                        runs += 1
                    at = max(at, end)
                kept = b"".join([*kept, data[at:]])
                for k, v in zip(out, (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept)):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], names=["id", *out])

    result = joined(located, spans, "spans", "left").mapInArrow(
        keep, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return result.withColumnRenamed("id", export_id)
