"""Periodic runs of words in every text, by a sparse dynamic program over diagonals.

Diagonal q of a text compares each word with the one q places earlier; a stretch of equal pairs on it is a stretch of
period q. Words are taken in order. A word's earlier occurrences lengthen the matches of the lags they lie at, and a lag
whose match ends is emitted as a run if it is long enough, else forgotten. Two facts make the table sparse:

- A run of period q and length max(24, 3q) or more has at least k equal pairs in a row on its diagonal, where k is 16 or
  the power of two with k/2 < q <= k. So only occurrences at the end of k equal words count; text that merely uses the
  same words again opens no diagonal.
- Of those at the same k only the latest earlier occurrence counts. If k words recur both q and d < q places back inside
  one run, then k + d >= q + d words have both periods, hence their greatest common divisor, and q isn't the smallest.

One lag for each word and k is thus active, whatever the text, and a text of n words costs n log n. Smallest periods and
both ends of a run come out of the table itself: on the diagonal of a run the latest occurrence stays at its period.
Python runs in Arrow batches over numpy arrays, all words of a few megabytes of text at once; no row leaves its task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SEPARATORS, WINDOW_BYTES, Words, byte_table, find_words, mix64, text_slices

#: A run has at least so many words and at least so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Equal pairs that every run has on its diagonal, and the first block length.
ANCHOR = 16

EXACT_TABLE = byte_table(3, False, SEPARATORS)
_U = np.uint64
_STEP = _U(0xA24BAED4963EE407)
BLANK = np.uint8(32)

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _doubled(blocks: np.ndarray, k: int) -> np.ndarray:
    """Hashes of blocks of 2k words from those of k words."""
    return mix64(blocks[:-k] * _STEP + blocks[k:]) if len(blocks) > k else np.zeros(0, _U)


def latest_lags(blocks: np.ndarray) -> np.ndarray:
    """For each place, how far back the same block last began; 0 where it didn't."""
    order = np.argsort(blocks, kind="stable")
    same = blocks[order[1:]] == blocks[order[:-1]]
    lags = np.zeros(len(blocks), dtype=np.int64)
    lags[order[1:][same]] = (order[1:] - order[:-1])[same]
    return lags


def runs_of(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs in word sequences laid end to end; `rows` tells them apart."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place = np.arange(len(hashes))
    blocks, k = mix64(hashes + mix64(rows.astype(_U) + _STEP)), 1
    while k < ANCHOR:
        blocks, k = _doubled(blocks, k), 2 * k
    shortest = 0
    while len(blocks):
        whole = rows[: len(blocks)] == rows[k - 1 :]
        lags = np.where(whole, latest_lags(blocks), 0)
        match = np.where((lags > shortest) & (lags <= k), lags, 0)
        # A lag's match goes on while the next word has it too; these are the places where one begins and where it ends.
        begins = np.flatnonzero((match > 0) & (np.append(0, match[:-1]) != match))
        ends = np.flatnonzero((match > 0) & (np.append(match[1:], 0) != match))
        period = match[begins]
        length = ends - begins + k + period
        enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append((place[begins][enough] - period[enough], length[enough], period[enough]))
        # Longer blocks recur only in texts in which these do.
        repeated = np.unique(rows[: len(blocks)][lags > 0])
        live = np.isin(rows, repeated)
        if not live.any():
            break
        shortest = k
        blocks, k = _doubled(np.append(blocks, np.zeros(len(rows) - len(blocks), _U))[live], k), 2 * k
        place, rows = place[live], rows[live]
        blocks = blocks[: max(0, len(rows) - k + 1)]
    starts, lengths, periods = (np.concatenate([r[c] for r in found]) if found else np.zeros(0, np.int64) for c in range(3))
    order = np.lexsort((periods, starts))
    return starts[order], lengths[order], periods[order]


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words of a text made periodic from some word on, as places in the text; None for texts that stay."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def joined(data: np.ndarray, words: Words, kept: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of the words `kept`, each followed by a blank, about a megabyte at a time."""
    lengths = words.ends[kept] - words.starts[kept] + 1
    to = np.append(0, np.cumsum(lengths))
    at = 0
    while at < len(kept):
        end = min(max(int(np.searchsorted(to, to[at] + WINDOW_BYTES, side="right")) - 1, at + 1), len(kept))
        size = lengths[at:end]
        begin = to[at:end] - to[at]
        source = np.arange(to[end] - to[at]) + np.repeat(words.starts[kept[at:end]] - begin, size)
        source[begin + size - 1] = 0
        text = data[source]
        text[begin + size - 1] = BLANK
        yield text
        at = end


def collapsed_digest(data: np.ndarray, words: Words, kept: np.ndarray) -> str:
    """sha256 of the words `kept`, joined by one blank."""
    digest, before = hashlib.sha256(), None
    for text in joined(data, words, kept):
        if before is not None:
            digest.update(before)
        before = text
    if before is not None:
        digest.update(before[:-1])
    return digest.hexdigest()


def detect(plant: bool):
    """For `mapInArrow` over (doc_id, text): a row of `SCHEMA` for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in SCHEMA.split(", ")])
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for part in text_slices(batch.column("text")):
                words = find_words(part, table=EXACT_TABLE)
                firsts = np.concatenate([[0], np.cumsum(words.counts)])
                order = np.arange(len(words.hashes))
                if plant:
                    for row, n in enumerate(words.counts.tolist()):
                        places = planted_order(ids[part.first + row], n)
                        if places is not None:
                            order[firsts[row] : firsts[row + 1]] = firsts[row] + places
                starts, lengths, periods = runs_of(words.hashes[order], words.rows)
                # A word is dropped if it lies in a run after its first period: +1 and -1 at the ends, summed up.
                edges = np.bincount(starts + periods, minlength=len(order) + 1) - np.bincount(starts + lengths, minlength=len(order) + 1)
                kept = np.cumsum(edges[:-1]) == 0
                bounds = np.searchsorted(starts, firsts)
                out = []
                for row, n in enumerate(words.counts.tolist()):
                    first, last = firsts[row], firsts[row + 1]
                    runs = range(bounds[row], bounds[row + 1])
                    listed = [(int(starts[r] - first), int(lengths[r]), int(periods[r])) for r in runs]
                    best: tuple[int, int, int] | None = None
                    for r in listed:  # in order of start and period, so that a tie leaves the earlier one
                        if best is None or r[1] * best[2] > best[1] * r[2]:
                            best = r
                    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in listed).encode()).hexdigest()
                    chosen = order[first:last][kept[first:last]]
                    out.append((
                        ids[part.first + row], n, len(listed), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                        digest, collapsed_digest(part.data, words, chosen),
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """A row for each row of `docs`: its runs' number and digest, the run of most periods, the text without repeats.

    A run is a stretch of words with smallest period q, of at least 24 words and 3 q, that no neighbouring word prolongs.
    `collapsed_sha256` is of the text without the words that lie in any run after that run's first period. The run of
    most periods is that of the greatest length / period, of equal ones the first, then the one of shorter period;
    without a run its four columns are NULL. `plant` makes a tenth of the texts, by crc32 of the id, periodic first, as
    a test with known answers.

    Words are split at ASCII white space and compared by a 64-bit hash, case included. NULL, empty and blank texts have
    no words, no runs and the digests of the empty text. A row without id keeps its NULL and is never made periodic.
    Repeated rows give repeated rows; other columns of `docs` are ignored; an empty table gives an empty result. A long
    text takes about 20 times its own bytes of a task's memory.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(detect(plant), SCHEMA)
