"""Spelling variants among the words of place names, by dense prefix-suffix tiling.

Works on the places that `parse_geocoder` and `parse_pois` return: any key columns of the stored
response, `position` and `name`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoterra.spread import attach, cut, discard, lookup

PLACE = ("response_id", "position")
LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
# One run in so many loses a letter: slips with known answers, to see what the grouping makes of them.
SLIP_EVERY = 97
# Words that a tile holds; words of one key beyond this are compared block by block.
TILE = 128
# Lengths that are common at once; only sets how many tiles there are.
_SPREAD = 10
# Cells of the matrices that tiles of one length share.
PIECE_CELLS = 4 << 20
TILE_ORDER = ("longer", "tile", "front", "one", "two")


def slipped(word: Column, key: Column, every: int) -> Column:
    """The word without one letter, if `every` divides the CRC-32 of `key:word`; which letter the remainder by its length says."""
    crc = F.crc32(F.concat(key, F.lit(":"), word).cast("binary"))
    at = F.pmod(crc, F.char_length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(F.pmod(crc, F.lit(every)) == 0, shorter).otherwise(word)


def name_words(
    places: DataFrame,
    keys: Sequence[str] = PLACE,
    name: str = "name",
    slip_every: int = SLIP_EVERY,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n): distinct words of whole names with at least `least_length` letters and `least_count` occurrences.

    Words are maximal runs of LETTERS with A-Z in lower case. Every `slip_every`-th occurrence, by a
    checksum of its keys (joined by colons, null as nothing) and the word, loses a letter. A null or
    empty name has no words; rows that repeat a key all count.
    """
    runs = places.select(
        F.concat_ws(":", *[places[k].cast("string") for k in keys]).alias("_key"),
        F.explode(F.regexp_extract_all(places[name], F.lit(LETTERS), F.lit(0))).alias("_run"),
    )
    run = F.col("_run")
    # Lower-casing all letters is fast; where it changes more than A-Z only those are translated.
    upper = "".join(map(chr, range(65, 91)))
    lowered = F.when(run == F.lower(run), run).otherwise(F.translate(run, upper, upper.lower()))
    words = runs.select("_key", lowered.alias("_run")).select(slipped(run, F.col("_key"), slip_every).alias("word"))
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


class Points:
    """Words of at most `width` letters as matrices of code points, from the front and from the back, padded with zeros."""

    def __init__(self, words: Sequence[str], width: int):
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.array([len(w) for w in words], np.int64)
        if not letters.size or letters.max() < 256:
            letters = letters.astype(np.uint8)
        row = np.repeat(np.arange(len(words)), self.size)
        column = np.arange(len(letters)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.ahead, self.back = (np.zeros((len(words), width), letters.dtype) for _ in range(2))
        self.ahead[row, column] = letters
        self.back[row, np.repeat(self.size, self.size) - 1 - column] = letters


def _shared(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many columns from the left are equal in row i of `a` and row j of `b`, for all i and j; at most `least`."""
    running, shared = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for n in range(a.shape[1]):
        running &= a[:, n, None] == b[None, :, n]
        if not running.any():
            break
        shared += running
    return np.minimum(shared, least)


def single_edits(points: Points, left: np.ndarray, right: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that differ by exactly one edit, and their common prefixes; the longer word has `longer` letters.

    `left` are rows of words of that length, `right` rows of that length or one less. The matrix of
    all pairs gets common prefix plus common suffix; a pair of different words for which they reach
    `longer - 1` differs by one inserted, deleted or replaced code point, and no other pair does.
    """
    least = np.minimum(points.size[left][:, None], points.size[right][None, :])
    prefix = _shared(points.ahead[left], points.ahead[right], least)
    suffix = _shared(points.back[left], points.back[right], least)
    i, j = np.nonzero((prefix + suffix >= longer - 1) & (prefix < longer))
    return left[i], right[j], prefix[i, j]


def _near_in_tile(points: Points, own: np.ndarray, rows: np.ndarray, key: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs among the rows of one tile, as rows."""
    longer, front, one, two = key
    whole, block = points.size[rows] == longer, own[rows]
    # Blocks of one key meet once; inside a block, and in a tile of small keys, all meet all.
    sides = [(rows[whole & (block == one)], rows[block == two])]
    if one != two:
        sides.append((rows[whole & (block == two)], rows[~whole & (block == one)]))
    found = [single_edits(points, left, right, longer) for left, right in sides if len(left) and len(right)]
    if not found:
        return rows[:0], rows[:0]
    i, j, prefix = (np.concatenate(x) for x in zip(*found))
    # A pair with a long common prefix belongs to the tiles by front, any other to those by back; two
    # words of one length and block meet twice.
    kept = ((prefix >= longer // 2) == front) & ((one != two) | (points.size[j] < longer) | (i < j))
    return i[kept], j[kept]


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each tile. A partition holds whole tiles, sorted by TILE_ORDER; a tile stays together over batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        starts = _starts(table)
        # The last tile may go on in the next batch.
        rest = table.slice(starts[-1]).combine_chunks().to_batches()[0]
        yield from _pieces(table, starts)
    if rest is not None:
        table = pa.Table.from_batches([rest])
        yield from _pieces(table, np.array([0, table.num_rows]))


def _starts(table: pa.Table) -> np.ndarray:
    """First rows of the tiles of a table."""
    columns = [table.column(c).to_numpy() for c in TILE_ORDER]
    changed = np.zeros(max(0, table.num_rows - 1), bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def _pieces(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Near pairs of the tiles between neighbouring `starts`; tiles of one length share their matrices up to PIECE_CELLS."""
    longer = table.column("longer").to_numpy()
    at = 0
    while at + 1 < len(starts):
        width, end = int(longer[starts[at]]), at + 1
        while end + 1 < len(starts) and longer[starts[end]] == width and (starts[end + 1] - starts[at]) * width <= PIECE_CELLS:
            end += 1
        part = table.slice(starts[at], starts[end] - starts[at])
        words = part.column("word").combine_chunks()
        points, own = Points(words.to_pylist(), width), part.column("block").to_numpy()
        front, one, two = (part.column(c).to_numpy() for c in ("front", "one", "two"))
        edges = (starts[at : end + 1] - starts[at]).tolist()
        found = [
            _near_in_tile(points, own, np.arange(b, e), (width, front[b], one[b], two[b])) for b, e in zip(edges, edges[1:]) if e - b > 1
        ]
        if found:
            a, b = (words.take(pa.array(np.concatenate(x))) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])
        at = end


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of the distinct words (`word`) that differ by exactly one edit; each pair once.

    If the longer one of two such words has m letters, they share their first m // 2 letters or else
    their last m - m // 2. So a word enters, for m its length and one more, a tile by its front and
    one by its back, and only words of one tile are compared, all with all. Small keys share a tile by
    a hash. The words of a key with more than `tile` of them are split into blocks of about that size,
    and every pair of blocks is a tile of its own, so no task gathers a hot key.
    """
    count = max(1, 4 * words.count() // (tile * _SPREAD))
    size = F.char_length("word")
    entries = [
        F.struct(longer.alias("longer"), F.lit(front).alias("front"), part.alias("part"))
        for longer in (size, size + 1)
        for front, part in (
            (True, F.substring(F.col("word"), F.lit(1), F.floor(longer / 2).cast("int"))),
            (False, F.right(F.col("word"), longer - F.floor(longer / 2).cast("int"))),
        )
    ]
    keyed = cut(words.select("word", F.explode(F.array(*entries)).alias("k")).select("word", "k.*"))
    on = ["longer", "front", "part"]
    hot = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile)
    hot = hot.select(*on, F.ceil(F.col("_n") / tile).cast("int").alias("_blocks"))
    # A key's own number parts its tiles from all others; small keys share the tiles below zero.
    placed = attach(keyed, hot, on, ["word"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int")
    lone = F.col("_blocks") == 1
    shared = -1 - F.pmod(F.xxhash64("part"), F.lit(count))
    placed = placed.withColumn("block", own).withColumn("tile", F.when(lone, shared).otherwise(F.shiftrightunsigned(F.xxhash64("part"), 1)))
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    met = F.transform(others, lambda o: F.struct(F.least("block", o).alias("one"), F.greatest("block", o).alias("two")))
    rows = placed.select("tile", "longer", "front", "block", "word", F.explode(met).alias("m")).select(
        "tile", "longer", "front", "m.one", "m.two", "block", "word"
    )
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *TILE_ORDER).sortWithinPartitions(*TILE_ORDER)
    pairs = cut(dealt.mapInArrow(_tile_pairs, "a string, b string"))
    discard(keyed)
    return pairs


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of the table (word, form): where following the forms ends.

    Each round doubles how far a word has come, so rounds are as few as the logarithm of the longest
    chain; a form is at least twice as frequent as its word, so no chain returns. Rounds are written to
    the shared folder.
    """
    moved = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = moved.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = cut(lookup(moved, onward, ["root"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")))
        discard(moved)
        moved = stepped
        if moved.where("_on").isEmpty():
            return moved.drop("_on")
        moved = moved.drop("_on")


def spelling_variants(
    places: DataFrame,
    keys: Sequence[str] = PLACE,
    name: str = "name",
    slip_every: int = SLIP_EVERY,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    tile: int = TILE,
) -> DataFrame:
    """Words of place names with the more frequent spelling they probably stand for.

    One row per word of `name_words`: word, form, root, n, n_near, form_n. `n_near` counts the words
    that differ by exactly one inserted, deleted or replaced letter; `form` is the most frequent of
    them (ties: the first in code-point order) if it occurs at least twice as often, else null, `form_n`
    its count; `root` is where following the forms ends, the word itself if it has none.

    Null and empty names give no words, an empty table no rows; rows that repeat a key count each;
    other columns of `places`, whatever their names, are ignored; very long runs are words like others.
    """
    words = cut(name_words(places, keys, name, slip_every, least_length, least_count))
    pairs = near_words(words.select("word"), tile)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    counted = lookup(both, words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), ["other"])
    # The greatest count and of these the first word: counts are negated so that one minimum finds both.
    best = counted.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("other"))).alias("_best")
    )
    judged = words.join(best.hint("merge"), "word", "left")
    taken = -F.col("_best.n") >= 2 * F.col("n")
    judged = cut(
        judged.select(
            "word", F.when(taken, F.col("_best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, -F.col("_best.n")).alias("form_n"),
        )
    )
    for copy in (pairs, words):
        discard(copy)
    roots = last_forms(judged.where("form is not null"))
    return judged.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
