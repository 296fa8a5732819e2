"""Language identification as mixture inference.

``learn`` counts hashed four-byte windows per language over all training
text. ``identify`` treats each document as a mixture: every word comes from
one language, drawn with the document's proportions, and its likelihood is the
product of its windows' probabilities. Expectation-maximisation finds the
proportions; the language set is the one with the best penalised likelihood
(half a log of the word count for each language beyond the first) among the
nested sets of the most probable languages, up to all that were learned. A
set size is left out only where no mixture at all could pay its penalty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unveil.llm.shared import text_of
from unveil.llm.textblocks import blocks, has_letter, per_row, window_slots, word_spans

WIDTH = 4
BITS = 16
ROUNDS = 8
UNKNOWN = "und"


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.3) -> tuple[list[str], np.ndarray]:
    """Languages in name order and the log probability of each slot in each.

    Rows with a null lang or text teach nothing. What reaches the driver is
    2**16 counts a language at most, whatever the size of the corpus.
    """

    def run(batches):
        counts: dict[str, np.ndarray] = {}

        def flush():
            for name, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "slot", "n"])
            counts.clear()

        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                slots = window_slots(data, WIDTH, BITS)
                names = rows.column(1).to_pylist()
                code = {x: i for i, x in enumerate(dict.fromkeys(names))}
                of_byte = np.repeat(np.array([code[x] for x in names]), np.diff(offsets))
                for name, i in code.items():
                    counts[name] = counts.get(name, 0) + np.bincount(slots[of_byte == i], minlength=1 << BITS)
                if len(counts) > 64:
                    yield from flush()
        yield from flush()

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text_of(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    table = rows.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((1 << BITS, len(names)))
    place = np.array([names.index(x) for x in names])
    lang_at = pa.compute.index_in(table["lang"], pa.array(names, pa.string())).to_numpy() if names else place
    if names:
        counts[table["slot"].to_numpy(), lang_at] = table["n"].to_numpy()
    probability = (counts + smooth) / (counts.sum(axis=0) + smooth * (1 << BITS))
    return names, np.log(probability).astype(np.float32)


def _em(likelihood: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per row and the log likelihood left in them, for words scaled by their best language."""
    words = np.diff(first)
    of_word = np.repeat(np.arange(len(words)), words)
    total = np.maximum(words, 1)[:, None]
    for _ in range(rounds):
        weight = share[of_word] * likelihood
        weight /= weight.sum(axis=1, keepdims=True)
        share = (per_row(weight, first) / total).astype(np.float32)
        share = np.maximum(share, 1e-9)
    return share, per_row(np.log((share[of_word] * likelihood).sum(axis=1)), first)


def _penalty(size: int, words: np.ndarray) -> np.ndarray:
    return 0.5 * (size - 1) * np.log(words) + 3.0 * (size - 1)


def mixtures(word_logs: np.ndarray, first: np.ndarray, most: int | None = None, rounds: int = ROUNDS) -> list[list[tuple[int, float]]]:
    """Per row the chosen languages with their proportions, largest first.

    ``word_logs`` has a row for each word. Ties go to the language that sorts
    first. A row without words has no language. ``most`` bounds the sets; they
    grow to all languages when it is not given.
    """
    words, k = np.diff(first), word_logs.shape[1]
    best = word_logs.max(axis=1, keepdims=True) if len(word_logs) else word_logs
    likelihood = np.exp(np.maximum(word_logs - best, -60)).astype(np.float32)
    share, full = _em(likelihood, first, np.full((len(words), k), 1 / k, np.float32), rounds)
    # no proportions have a log likelihood beyond this (Jensen, from the shares reached); 1 covers rounding
    mixed = (share[np.repeat(np.arange(len(words)), words)] * likelihood).sum(axis=1, keepdims=True)
    gain = per_row(likelihood / mixed, first).max(axis=1) / np.maximum(words, 1)
    bound = np.minimum(full + words * np.log(np.maximum(gain, 1.0)), 0.0) + 1.0
    alone = per_row(np.maximum(word_logs - best, -60), first)
    top = alone.argmax(axis=1)
    share[np.arange(len(words)), top] += 1.0  # the best single language heads the nested sets
    order = np.argsort(-share, axis=1, kind="stable")
    chosen = [[(int(t), 1.0)] if n else [] for t, n in zip(top, words)]
    value = alone.max(axis=1)
    active = np.flatnonzero(words > 1)
    for size in range(2, min(most or k, k) + 1):
        active = active[bound[active] - _penalty(size, words[active]) > value[active]]
        if not len(active):
            break
        runs = [np.arange(first[i], first[i + 1]) for i in active]
        sub = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        pick = np.repeat(order[active, :size], words[active], axis=0)
        part = np.take_along_axis(likelihood[np.concatenate(runs)], pick, axis=1) + np.float32(1e-30)
        mixed, logs = _em(part, sub, np.full((len(active), size), 1 / size, np.float32), rounds)
        logs -= _penalty(size, words[active])
        better = logs > value[active]
        for j in np.flatnonzero(better):
            i = active[j]
            value[i] = logs[j]
            chosen[i] = sorted(((int(x), float(s)) for x, s in zip(order[i, :size], mixed[j])), key=lambda z: (-z[1], z[0]))
    return chosen


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score", mix: str = "languages") -> DataFrame:
    """``docs`` with the predicted language, its proportion, and the language set.

    A text that is null or has no letter (empty texts too), and every text
    when nothing was learned, gets ``und``, score 0 and an empty set. Columns
    of ``docs`` that have the names of the new ones are replaced; the others
    pass through unread.
    """
    names, logs = model
    kept = [c for c in docs.columns if c not in (pred, score, mix)]
    rows = docs.select(*kept, text_of(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    place = len(kept)
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(mix, T.ArrayType(T.StringType()))])
    out = [f.name for f in schema.fields]

    def run(batches):
        table = shared.value
        for batch in batches:
            for rows, data, offsets in blocks(batch, "__text"):
                letters = has_letter(rows.column(place), data, offsets)
                if names and len(data):
                    starts, ends, first = word_spans(data, offsets)
                    sums = np.zeros((len(data) + 1, len(names)))
                    np.cumsum(table[window_slots(data, WIDTH, BITS)], axis=0, dtype=np.float64, out=sums[1:])
                    found = mixtures((sums[ends] - sums[starts]).astype(np.float32), first)
                else:
                    found = [[] for _ in letters]
                found = [f if ok else [] for f, ok in zip(found, letters)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns[:place],
                        pa.array([names[f[0][0]] if f else UNKNOWN for f in found], pa.string()),
                        pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                        pa.array([[names[i] for i, _ in f] for f in found], pa.list_(pa.string())),
                    ],
                    out,
                )

    return rows.mapInArrow(run, schema)
