"""Training sequences of bounded length from place names in their given order.

Works on the library's places (place_id, name), one text per place. The cuts between sequences are
chosen by dynamic programming: a sequence may end after a place, after a sentence or, where a sentence
is longer than a sequence, anywhere; the sum of padding and of penalties for divided texts is least.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoterra.llm.batches import named, per_worker, slices
from isoterra.llm.tokens import encoder

LENGTH = 4096
END_ID = 2
# What a divided text costs, in tokens of padding: at a sentence, and inside one.
SENTENCE_PENALTY, INSIDE_PENALTY = 8, 64
# Ids that are planned together; a plan's last sequence stays open and goes on with the next ids.
PLAN_IDS = 1 << 21
# Sequence numbers of a partition start at its number times this.
PART_SEQUENCES = 1 << 32
_SENTENCE_END = re.compile(r"^[^\w\s]*[.!?][^\w\s]*$")


def best_cuts(ends: list[int], penalties: list[int], length: int = LENGTH) -> list[int]:
    """The ends of sequences that cover 0..ends[-1] at least cost.

    `ends` are the allowed ends, ascending, at most `length` apart, the last one compulsory. A
    sequence from b to e costs length - (e - b) plus the penalty of e. The best plan up to e is
    penalty(e) + length - e + min(plan(b) + b) over the b at most `length` before e; the candidates
    of that minimum stand in a queue of growing values, so every end enters and leaves it once.
    """
    places, cost, back = [0, *ends], [0] * (len(ends) + 1), [0] * (len(ends) + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(places)):
        end = places[j]
        while places[queue[0][1]] < end - length:
            queue.popleft()
        value, i = queue[0]
        cost[j], back[j] = penalties[j - 1] + length - end + value, i
        through = cost[j] + end
        while queue and queue[-1][0] > through:
            queue.pop()
        queue.append((through, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


def allowed_ends(ids: np.ndarray, document_ends: np.ndarray, sentence_ids: np.ndarray, length: int, total: int) -> tuple[list[int], list[int]]:
    """Places where a sequence may end, and what each costs.

    Where sentences are longer than a sequence, further places are set `length` after one another.
    """
    sentences = np.flatnonzero(np.isin(ids, sentence_ids)) + 1
    ends = np.union1d(np.union1d(sentences, document_ends), [total]).astype(np.int64)
    ends = ends[(ends > 0) & (ends <= total)]
    gaps = np.diff(ends, prepend=0)
    wide = np.flatnonzero(gaps > length)
    if len(wide):
        more = [np.arange(ends[i] - gaps[i] + length, ends[i], length) for i in wide]
        ends = np.union1d(ends, np.concatenate(more))
    penalties = np.full(len(ends), INSIDE_PENALTY)
    penalties[np.isin(ends, sentences)] = SENTENCE_PENALTY
    penalties[np.isin(ends, document_ends)] = 0
    return ends.tolist(), penalties.tolist()


class _Plan:
    """Pieces of one partition: takes documents in order, gives finished sequences."""

    def __init__(self, length: int, sentence_ids: np.ndarray):
        self.length, self.sentence_ids, self.sequence = length, sentence_ids, 0
        # Documents not yet given out in full: key, all ids, ids already given out.
        self.waiting: list[list] = []
        self.held = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.waiting.append([key, ids, 0])
        self.held += len(ids)

    def give(self, last: bool = False) -> Iterator[tuple]:
        """Pieces (key, start, length, crc, document ids, sequence, offset); unless `last`, the tail stays."""
        if not self.held:
            return
        rest = [ids[given:] for _, ids, given in self.waiting]
        ends = np.cumsum([len(r) for r in rest])
        places, penalties = allowed_ends(np.concatenate(rest), ends, self.sentence_ids, self.length, int(ends[-1]))
        cuts = best_cuts(places, penalties, self.length)
        if not last:
            # The end of this plan is no end of the texts: its last two sequences are planned again.
            cuts = cuts[:-2]
        at, position = 0, 0
        for cut_end in cuts:
            offset = 0
            while position < cut_end:
                key, ids, given = self.waiting[at]
                size = min(cut_end - position, len(ids) - given)
                piece = ids[given : given + size]
                yield key, given, size, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), self.sequence, offset
                self.waiting[at][2] = given + size
                position, offset = position + size, offset + size
                if given + size == len(ids):
                    at += 1
            self.sequence += 1
        self.waiting, self.held = self.waiting[at:], self.held - position


def _sentence_ids(vocabulary: str) -> np.ndarray:
    tokens = encoder(vocabulary).tokenizer.get_vocab().items()
    return np.array(sorted(i for t, i in tokens if _SENTENCE_END.match(t.removesuffix("</w>"))), np.uint32)


def pack_places(
    places: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, key: str = "place_id", name: str = "name"
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A name's ids are those of the vocabulary file and `end_id`; a null or empty name has only the end
    id. Rows are range-partitioned by key, and a partition fills its own sequences in order of key and
    name, so order is kept and a lost task repeats with the same result. Memory holds the ids of one
    plan, or of one name where that is longer. Rows that repeat a key are packed one after the other,
    rows without a key first; an empty table has no pieces. `sequence_id` grows with the order; its
    upper half is the partition.
    """
    source = places.schema[key].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() * PART_SEQUENCES
        sentence_ids = per_worker(f"sentence ends {vocabulary}", lambda: _sentence_ids(vocabulary))
        plan = _Plan(length, sentence_ids)

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            columns[5] = [base + s for s in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in (part for whole in batches for part in slices(whole)):
            for k, data in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(batch.column(1).to_pylist())):
                plan.add(k, np.append(np.frombuffer(data, "<u4"), np.uint32(end_id)))
                if plan.held >= PLAN_IDS and (pieces := list(plan.give())):
                    yield rows(pieces)
        if pieces := list(plan.give(last=True)):
            yield rows(pieces)

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 7
    ordered = named(places, key=key, name=name).select(F.col("key").cast("long").alias("key"), "name")
    ordered = ordered.repartitionByRange("key").sortWithinPartitions("key", "name")
    packed = ordered.mapInArrow(pack, ", ".join(f"`{n}` long" for n in names))
    return packed.withColumn(key, F.col(key).cast(source))
