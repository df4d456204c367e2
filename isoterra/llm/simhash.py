"""Near copies among stored responses, by SimHash fingerprints and multi-index hashing.

Works on the library's stored responses (response_id, body).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoterra.llm.batches import Lists, in_batches, named
from isoterra.llm.links import smallest_reachable
from isoterra.spread import cut

SHINGLE_WORDS = 4
SEED = 42
BITS = 64
DISTANCE = 4
SEGMENTS = 3
# Shingles that are hashed together; bounds the memory of a very long body.
_BLOCK = 1 << 16


def fingerprint(body: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text: a bit is set if over half of the shingle hashes have it.

    Words are what white space separates, A-Z in lower case; a text of fewer words is one shingle, a
    text without words has fingerprint zero.
    """
    from xxhash import xxh64_intdigest

    parts = (body or "").encode().lower().split()
    if not parts:
        return 0
    size, text = min(words, len(parts)), b" ".join(parts)
    count = len(parts) - size + 1
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[size - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, _BLOCK):
        spans = zip(starts[at : min(at + _BLOCK, count)].tolist(), ends[at : at + _BLOCK].tolist())
        hashes = np.array([xxh64_intdigest(text[b:e], SEED) for b, e in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def _layout(segments: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) per segment.

    If two fingerprints differ in at most `distance` bits, some segment differs in at most its radius:
    with distance = q * segments + r the first r + 1 segments get radius q and the others q - 1.
    """
    quotient, rest = divmod(distance, segments)
    shift, out = 0, []
    for n in range(segments):
        bits = BITS // segments + (n < BITS % segments)
        out.append((shift, bits, quotient if n <= rest else quotient - 1))
        shift += bits
    return out


def _ball(bits: int, radius: int) -> list[int]:
    """All masks of at most `radius` bits."""
    masks, ring = [0], [0]
    for _ in range(radius):
        ring = sorted({m | 1 << b for m in ring for b in range(bits) if not m >> b & 1})
        masks += ring
    return masks


def near_fingerprints(fingerprints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b) of different fingerprints (bigint) of at most `distance` differing bits, from a table of distinct ones.

    Each fingerprint enters one table per segment under the segment's value. It asks each table for the
    values in a small Hamming ball around its own, and complete distances decide. Of two segments at
    distance one or more, the lowest differing bit is set on one side only, and that side alone asks
    with it, so the ball is half as large and a pair meets once per segment that can find it; pairs of
    equal segments are met in ascending order.
    """
    f = F.col("fingerprint")
    layout = [s for s in _layout(segments, distance) if s[2] >= 0]

    def value(shift: int, bits: int) -> Column:
        return F.shiftrightunsigned(f, shift).bitwiseAND(F.lit((1 << bits) - 1))

    def asked(n: int, shift: int, bits: int, radius: int) -> Column:
        own = value(shift, bits)
        lowest = {m: m & -m for m in _ball(bits, radius)}
        probes = [
            F.when(F.lit(True) if not m else own.bitwiseAND(F.lit(low)) != 0, F.struct(F.lit(n).alias("n"), own.bitwiseXOR(F.lit(m)).alias("value")))
            for m, low in lowest.items()
        ]
        return F.array_compact(F.array(*probes))

    tables = F.array(*[F.struct(F.lit(n).alias("n"), value(s, b).alias("value")) for n, (s, b, _) in enumerate(layout)])
    entries = fingerprints.select(F.explode(tables).alias("k"), f.alias("b")).select("k.n", "k.value", "b")
    asks = F.flatten(F.array(*[asked(n, *s) for n, s in enumerate(layout)]))
    questions = fingerprints.select(F.explode(asks).alias("k"), f.alias("a")).select("k.n", "k.value", "a")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # With an equal segment both sides find the other, so the smaller one asks; else only one side finds it.
    segment = F.lit(False)
    for n, (shift, bits, _) in enumerate(layout):
        part = F.shiftrightunsigned(F.col("a").bitwiseXOR(F.col("b")), shift).bitwiseAND(F.lit((1 << bits) - 1))
        segment = F.when(F.col("n") == n, part == 0).otherwise(segment)
    found = questions.join(entries, ["n", "value"]).where((apart <= distance) & (F.col("a") != F.col("b")))
    return found.where(~segment | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(
    responses: DataFrame, response_id: str = "response_id", body: str = "body", distance: int = DISTANCE, segments: int = SEGMENTS
) -> DataFrame:
    """One row per response: id, fingerprint (16 hex digits), component_id, the smallest id reachable by links.

    Two responses are linked if their fingerprints differ in at most `distance` bits. Responses with one
    fingerprint are one node, the smallest of their ids, so copies never meet as pairs. A null or blank
    body has fingerprint zero and is linked like any other; rows that repeat an id each get a row; a
    row without an id is linked by its fingerprint and never names a component (a group of only such
    rows has a null component); an empty table gives no rows.
    """
    kind = responses.schema[response_id].dataType

    def hashed(lists: Lists) -> Lists:
        values = [fingerprint(t) for t in lists["body"]]
        return {"id": lists["id"], "fingerprint": [v - (1 << 64) if v >> 63 else v for v in values]}

    rows = cut(in_batches(named(responses, id=response_id, body=body), hashed, f"id {kind.simpleString()}, fingerprint long"))
    nodes = cut(rows.groupBy("fingerprint").agg(F.min("id").alias("node")))
    pairs = near_fingerprints(nodes.select("fingerprint"), distance, segments)
    roots = smallest_reachable(pairs)
    # Roots are fingerprints; the component is named by the smallest id of all its nodes.
    named_nodes = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    smallest = named_nodes.groupBy("root").agg(F.min("node").alias("component_id"))
    components = named_nodes.join(smallest, "root").select("fingerprint", "component_id")
    return rows.join(components, "fingerprint").select(
        F.col("id").alias(response_id), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )
