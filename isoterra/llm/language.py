"""Language of place names by a small bidirectional recurrent network over bytes.

Works on the library's places (place_id, name) with an optional language column. A gated recurrent
network reads every word of letters forwards and backwards, labels each of its bytes with
probabilities, and a name's probabilities are the mean over all its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoterra.llm.batches import Lists, in_batches, named

UNKNOWN = "und"
HIDDEN = 12
# Bytes of a word that are read as one sequence; a longer word is read in several.
LONGEST = 32
# Bounds of the training sample: labelled names, and different words of each language.
SAMPLE_NAMES, SAMPLE_WORDS = 3000, 12_000
STEPS, BATCH, RATE, RANDOM = 700, 192, 0.01, 7
# Different words whose probabilities a task remembers.
KEPT_WORDS = 400_000
# Words that are read together.
_ROWS = 1024
_LETTERS = re.compile(r"[^\W\d_]+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Weights by name; `f_` belongs to the forward and `b_` to the backward direction."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(languages: list[str], hidden: int = HIDDEN, random: int = RANDOM) -> Network:
        draw = np.random.default_rng(random)
        scale = 1 / np.sqrt(hidden)
        weights = {"out": draw.normal(0, scale, (2 * hidden, len(languages))), "bias": np.zeros(len(languages))}
        for d in "fb":
            # Columns: update gate, reset gate, candidate.
            weights[f"{d}_in"] = draw.normal(0, 0.3, (256, 3 * hidden))
            weights[f"{d}_gates"] = draw.normal(0, scale, (hidden, 2 * hidden))
            weights[f"{d}_state"] = draw.normal(0, scale, (hidden, hidden))
        return Network(languages, {k: w.astype(np.float32) for k, w in weights.items()})

    def _direction(self, d: str, data: np.ndarray, trace: list | None) -> np.ndarray:
        """States after every byte of equally long words (words x bytes)."""
        w_in, gates, state = (self.weights[f"{d}_{k}"] for k in ("in", "gates", "state"))
        n, length, size = len(data), data.shape[1], state.shape[0]
        h, out = np.zeros((n, size), np.float32), np.empty((n, length, size), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            x = w_in[data[:, t]]
            zr = _sigmoid(x[:, : 2 * size] + h @ gates)
            z, r = zr[:, :size], zr[:, size:]
            c = np.tanh(x[:, 2 * size :] + (r * h) @ state)
            new = h + z * (c - h)
            if trace is not None:
                trace.append((t, h, zr, c))
            out[:, t], h = new, new
        return out

    def label(self, data: np.ndarray, traces: dict | None = None) -> np.ndarray:
        """Probabilities (words x bytes x languages) of the bytes of equally long words."""
        traces = traces if traces is not None else {"f": None, "b": None}
        states = np.concatenate([self._direction(d, data, traces[d]) for d in "fb"], axis=2)
        traces["states"] = states
        scores = states @ self.weights["out"] + self.weights["bias"]
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        return scores / scores.sum(axis=2, keepdims=True)

    def gradients(self, data: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all bytes, and its gradients by backpropagation through time."""
        traces: dict = {"f": [], "b": []}
        p = self.label(data, traces)
        n, length, _ = p.shape
        loss = -float(np.mean(np.log(p[np.arange(n), :, targets] + 1e-12)))
        error = p.copy()
        error[np.arange(n), :, targets] -= 1
        error /= n * length
        states, size = traces["states"], self.weights["f_state"].shape[0]
        grads = {k: np.zeros_like(w) for k, w in self.weights.items()}
        grads["out"] = states.reshape(-1, 2 * size).T @ error.reshape(-1, p.shape[2])
        grads["bias"] = error.sum(axis=(0, 1))
        onto = error @ self.weights["out"].T
        for d, part in (("f", onto[:, :, :size]), ("b", onto[:, :, size:])):
            gates, state = self.weights[f"{d}_gates"], self.weights[f"{d}_state"]
            later = np.zeros((n, size), np.float32)
            for t, h, zr, c in reversed(traces[d]):
                z, r = zr[:, :size], zr[:, size:]
                dh = part[:, t] + later
                dc = dh * z * (1 - c * c)
                inner = dc @ state.T
                dzr = np.concatenate([dh * (c - h), inner * h], axis=1) * zr * (1 - zr)
                grads[f"{d}_state"] += (r * h).T @ dc
                grads[f"{d}_gates"] += h.T @ dzr
                np.add.at(grads[f"{d}_in"], data[:, t], np.concatenate([dzr, dc], axis=1))
                later = dh * (1 - z) + inner * r + dzr @ gates.T
        return loss, grads


def _by_length(words: list[bytes]) -> dict[int, np.ndarray]:
    """Positions of words by length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def _matrix(words: list[bytes], places: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join([words[i] for i in places.tolist()]), np.uint8).reshape(-1, length)


def train(samples: list[tuple[str, str, int]], hidden: int = HIDDEN, steps: int = STEPS, random: int = RANDOM) -> Network | None:
    """Fit a network to (language, word, count) rows; None without rows.

    Every language weighs the same however many names it has, and a word the square root of its count.
    """
    languages = sorted({lang for lang, _, _ in samples})
    if not languages:
        return None
    words = [w.encode()[:LONGEST] for _, w, _ in samples]
    targets = np.array([languages.index(lang) for lang, _, _ in samples])
    weight = np.sqrt(np.array([c for _, _, c in samples], np.float64))
    weight /= np.bincount(targets, weight, len(languages))[targets]
    groups = _by_length(words)
    data = {n: _matrix(words, places, n) for n, places in groups.items()}
    sums = {n: np.cumsum(weight[places]) for n, places in groups.items()}
    lengths = sorted(groups)
    shares = np.array([sums[n][-1] for n in lengths])
    network, draw = Network.new(languages, hidden, random), np.random.default_rng(random)
    mean = {k: np.zeros_like(w) for k, w in network.weights.items()}
    square = {k: np.zeros_like(w) for k, w in network.weights.items()}
    for step in range(1, steps + 1):
        n = lengths[draw.choice(len(lengths), p=shares / shares.sum())]
        picked = np.searchsorted(sums[n], draw.random(BATCH) * sums[n][-1])
        picked = np.minimum(picked, len(sums[n]) - 1)
        _, grads = network.gradients(data[n][picked], targets[groups[n]][picked])
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
            network.weights[k] -= (rate * (mean[k] / fix) / (np.sqrt(square[k] / fix2) + 1e-6)).astype(np.float32)
    return network


def words_of(name: str) -> list[str]:
    """All runs of letters of a whole name, in lower case."""
    return _LETTERS.findall(name.lower())


class Judge:
    """Pools the network's byte probabilities over names, remembering the words it has read."""

    def __init__(self, network: Network, kept: int = KEPT_WORDS):
        self.network, self.kept, self.row = network, kept, {}
        self.sums = np.zeros((0, len(network.languages) + 1))

    def _read(self, words: list[str]) -> np.ndarray:
        """Per word the sums of its bytes' probabilities, and its bytes."""
        parts, owner = [], []
        for n, word in enumerate(words):
            data = word.encode()
            for at in range(0, len(data), LONGEST):
                parts.append(data[at : at + LONGEST])
                owner.append(n)
        owners, sums = np.array(owner), np.zeros((len(words), len(self.network.languages) + 1))
        for length, places in _by_length(parts).items():
            for at in range(0, len(places), _ROWS):
                some = places[at : at + _ROWS]
                p = self.network.label(_matrix(parts, some, length)).sum(axis=1)
                np.add.at(sums, owners[some], np.concatenate([p, np.full((len(some), 1), length)], axis=1))
        return sums

    def pool(self, names: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of every whole name; names without a letter are unknown, with 0."""
        if len(self.row) > self.kept:
            self.row, self.sums = {}, self.sums[:0]
        split = [words_of(name) if name else [] for name in names]
        missing = sorted(set().union(*split).difference(self.row))
        if missing:
            self.row.update(zip(missing, range(len(self.row), len(self.row) + len(missing))))
            self.sums = np.concatenate([self.sums, self._read(missing)])
        found, out = self.row.__getitem__, []
        for words in split:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.sums[np.fromiter(map(found, words), np.int64, len(words))].sum(axis=0)
            best = int(np.argmax(total[:-1]))
            out.append((self.network.languages[best], min(1.0, float(total[best] / total[-1]))))
        return out


def training_sample(labelled: DataFrame, name: str, lang: str, key: str, names: int, words: int) -> list[tuple[str, str, int]]:
    """(language, word, count) of at most `names` labelled names and `words` words of each language.

    The names are those whose keys have the smallest hashes; only that bound of the hashes comes to the
    driver first, then the counted words.
    """
    rows = named(labelled, key=key, name=name, lang=lang).where("name is not null and lang is not null")
    hashed = rows.withColumn("_hash", F.xxhash64("key", F.lit(RANDOM)))
    smallest = hashed.select("_hash").orderBy("_hash").limit(names).agg(F.max("_hash")).first()[0]
    if smallest is None:
        return []
    found = F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"(\p{L}+)"), 1)).alias("word")
    counts = hashed.where(F.col("_hash") <= smallest).select("lang", found).groupBy("lang", "word").count()
    out: list[tuple[str, str, int]] = []
    for (language,) in sorted(counts.select("lang").distinct().collect()):
        top = counts.where(F.col("lang") == language).orderBy(F.desc("count"), "word").limit(words)
        out += [(language, r["word"], r["count"]) for r in top.collect()]
    return out


def identify_language(
    places: DataFrame,
    labelled: DataFrame,
    key: str = "place_id",
    name: str = "name",
    lang: str = "lang",
    sample_names: int = SAMPLE_NAMES,
    sample_words: int = SAMPLE_WORDS,
    steps: int = STEPS,
    carried: Sequence[str] = (),
) -> DataFrame:
    """One row per place: the `carried` columns, key, lang_pred, score (0 to 1).

    The network is trained on the driver with a bounded sample of `labelled`, a table with the same key,
    name and language columns; rows without a name or language teach nothing. The prediction sees
    nothing but the whole name. A name that is null, empty or has no letter is `und` with score 0, and so
    is every name if nothing was labelled; rows that repeat a key are judged one by one.
    """
    sample = training_sample(labelled, name, lang, key, sample_names, sample_words)
    network = train(sample, steps=steps)

    kind = places.schema[key].dataType.simpleString()
    judge = None

    def predict(lists: Lists) -> Lists:
        nonlocal judge
        if network is None:
            return {"key": lists["key"], "lang_pred": [UNKNOWN] * len(lists["key"]), "score": [0.0] * len(lists["key"])}
        judge = judge or Judge(network)
        pooled = judge.pool(lists["name"])
        return {"key": lists["key"], "lang_pred": [p for p, _ in pooled], "score": [s for _, s in pooled]}

    # Carried columns travel under numbers, so none can clash with those of the operator.
    kept = {f"_{n}": c for n, c in enumerate(carried)}
    rows = named(places, **kept, key=key, name=name)
    judged = in_batches(rows, predict, f"key {kind}, lang_pred string, score double", list(kept))
    return judged.select(*[judged[n].alias(c) for n, c in kept.items()], judged["key"].alias(key), "lang_pred", "score")


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: CRC-32 of its key as text, modulo 4, is 2."""
    return F.crc32(key.cast("string")) % 4 == 2
