"""Byte-level BPE by speculation and verification.

Texts are cut into pieces as the tokenizer's pre-tokenizer does, by runs of character classes. The distinct pieces of a
slice of text are encoded together: a walk along a trie proposes the longest token at every place, for all pieces at a
time. A proposal is what merging gives exactly if each pair of neighbours is compatible, that is, if no merge joins a
right edge of the one with a left edge of the other before either is merged away inside its token. All distinct pairs
are tested at a time, and only pieces with an incompatible pair are merged step by step.

The vocabulary file is a parameter; its tables are built on the driver, a few megabytes, and sent with the tasks.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import SPAN_TABLE, Slice, freed, span_hashes, text_slices

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Unicode's White_Space characters (fixed values).
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Ends of contractions that are pieces of their own after an apostrophe (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct pieces whose tokens a task remembers.
REMEMBERED = 200_000
#: Bytes of text that are encoded at once; each takes some tens of bytes of memory meanwhile.
PART_BYTES = 1 << 19
NEVER = np.iinfo(np.int32).max
#: Longest piece, in bytes, that is merged together with others.
SHORT = 48


def character_classes() -> np.ndarray:
    """The class of every code point, from its general category."""
    classes = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            classes[code] = LETTER
        elif kind == "N":
            classes[code] = NUMBER
    classes[WHITE_SPACE] = SPACE
    return classes


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Tables of a byte-level BPE vocabulary."""

    classes: np.ndarray
    token_bytes: np.ndarray
    token_offsets: np.ndarray
    edges: np.ndarray  # node * 256 + byte, ascending
    targets: np.ndarray  # the node each edge leads to
    node_token: np.ndarray  # the token that ends at a node, or -1
    pair_keys: np.ndarray  # left << 32 | right, ascending
    pair_ranks: np.ndarray
    pair_merged: np.ndarray
    rights: np.ndarray  # by token: itself, its right part, that one's right part, ...; -1 beyond
    rights_until: np.ndarray  # the rank of the merge that ends each of them
    lefts: np.ndarray
    lefts_until: np.ndarray
    byte_tokens: np.ndarray
    special: dict[bytes, int]


def _spine(part: np.ndarray, born: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains of parts, and until when (merge rank) each part stands alone."""
    chain, until = [np.arange(len(part))], [np.full(len(part), NEVER)]
    while True:
        last = chain[-1]
        following = np.where(last >= 0, part[np.maximum(last, 0)], -1)
        if not (following >= 0).any():
            return np.stack(chain, axis=1).astype(np.int32), np.stack(until, axis=1).astype(np.int32)
        until.append(np.where(following >= 0, born[np.maximum(last, 0)], -1))
        chain.append(following)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library: its vocab, merges and added tokens."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, to_byte = content["model"], byte_characters()
    added = {a["content"]: a["id"] for a in content["added_tokens"]}
    n = max([*model["vocab"].values(), *added.values()]) + 1
    texts = [b""] * n
    for token, number in model["vocab"].items():
        texts[number] = bytes(to_byte[c] for c in token)
    for token, number in added.items():
        texts[number] = token.encode()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    nodes: dict[int, int] = {}
    ends = {0: -1}
    for number in model["vocab"].values():
        node = 0
        for byte in texts[number]:
            node = nodes.setdefault(node * 256 + byte, len(nodes) + 1)
            ends.setdefault(node, -1)
        ends[node] = number
    edges = np.array(sorted(nodes), dtype=np.int64)
    left, right, born = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    keys, merged = [], []
    for rank, pair in enumerate(model["merges"]):
        a, b = (model["vocab"][x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
        whole = model["vocab"]["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")]
        keys.append(a << 32 | b)
        merged.append(whole)
        if born[whole] < 0:
            left[whole], right[whole], born[whole] = a, b, rank
    order = np.argsort(keys)
    single = np.zeros(256, dtype=np.int64)
    for number in model["vocab"].values():
        if len(texts[number]) == 1:
            single[texts[number][0]] = number
    rights, rights_until = _spine(right, born)
    lefts, lefts_until = _spine(left, born)
    return Vocabulary(
        character_classes(), np.frombuffer(b"".join(texts), np.uint8), offsets, edges, np.array([nodes[e] for e in edges.tolist()]),
        np.array([ends[i] for i in range(len(ends))]), np.array(keys)[order], order.astype(np.int32), np.array(merged)[order],
        rights, rights_until, lefts, lefts_until, single, {t.encode(): i for t, i in added.items()},
    )


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `wanted` stand in ascending `keys`, and whether they do."""
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def cut_pieces(part: Slice, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pieces start, and the id of those that are added tokens (else -1).

    Pieces: contractions after an apostrophe; runs of letters, of numbers or of other characters, with a blank before;
    white space, of which the last character is left to a following piece (or alone, if it isn't a blank).
    """
    data, offsets = part.data, part.offsets
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first_byte = (data & 0xC0) != 0x80
    char_starts = np.flatnonzero(first_byte)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(codes)
    char_at = np.cumsum(first_byte) - 1
    begins = np.zeros(n + 1, dtype=bool)  # where texts, and the parts between added tokens, begin
    filled = offsets[:-1][np.diff(offsets) > 0]
    begins[char_at[filled]] = True
    begins[n] = True
    specials: list[tuple[int, int, int]] = []
    raw = data.tobytes() if vocabulary.special else b""
    for token, number in vocabulary.special.items():
        at = raw.find(token)
        while at >= 0:
            row = np.searchsorted(offsets, at, side="right") - 1
            if at + len(token) <= offsets[row + 1]:
                a, b = int(char_at[at]), int(char_at[at]) + len(token.decode())
                specials.append((a, b, number))
                begins[[a, b]] = True
                at = raw.find(token, at + len(token))
            else:
                at = raw.find(token, at + 1)
    classes = vocabulary.classes[codes]
    change = begins[:-1].copy()
    change[1:] |= classes[1:] != classes[:-1]
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], n)
    kinds = classes[runs]
    marks = change
    space = kinds == SPACE
    inner = space & ~begins[ends]  # followed by something in the same text
    last = ends[inner] - 1
    marks[last] = True
    blank = codes[last] == 0x20
    marks[ends[inner][blank]] = False
    joined = np.zeros(n + 1, dtype=bool)
    joined[ends[inner][blank]] = True
    quote = np.flatnonzero((kinds == OTHER) & (ends - runs == 1) & (codes[runs] == ord("'")) & ~joined[runs] & ~begins[ends])
    quote = quote[kinds[quote + 1] == LETTER] if len(quote) else quote
    padded = np.append(codes, [0, 0])
    for suffix in CONTRACTIONS:
        start = ends[quote]
        fits = np.ones(len(quote), dtype=bool)
        for k, letter in enumerate(suffix):
            fits &= padded[start + k] == ord(letter)
        fits &= ends[quote + 1] - start >= len(suffix)
        hit = quote[fits]
        marks[ends[hit]] = False
        rest = ends[hit] + len(suffix)
        marks[rest[rest < ends[hit + 1]]] = True
        quote = quote[~fits]
    ids = np.full(n, -1, dtype=np.int64)
    for a, b, number in specials:
        marks[a + 1 : b] = False
        marks[a] = True
        if b < n:
            marks[b] = True
        ids[a] = number
    at = np.flatnonzero(marks)
    return char_starts[at], ids[at]


def propose(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Greedy longest tokens of every piece: (piece, token) in order of pieces and places."""
    pieces, tokens = [], []
    active, at = np.arange(len(starts)), starts.copy()
    while len(active):
        node = np.zeros(len(active), dtype=np.int64)
        best, best_end = np.full(len(active), -1), at[active].copy()
        walking, place = np.arange(len(active)), at[active].copy()
        while len(walking):
            edge, known = _lookup(v.edges, node[walking] * 256 + data[place[walking]])
            walking = walking[known]
            node[walking] = v.targets[edge[known]]
            place[walking] += 1
            token = v.node_token[node[walking]]
            full = token >= 0
            best[walking[full]] = token[full]
            best_end[walking[full]] = place[walking[full]]
            walking = walking[place[walking] < ends[active[walking]]]
        pieces.append(active)
        tokens.append(best)
        at[active] = best_end
        active = active[at[active] < ends[active]]
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, found = np.concatenate(pieces), np.concatenate(tokens)
    order = np.argsort(owner, kind="stable")
    return owner[order], found[order]


def compatible(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Whether merging the bytes of two tokens gives these two tokens again."""
    good = np.ones(len(left), dtype=bool)
    for i in range(v.rights.shape[1]):
        a, a_until = v.rights[left, i], v.rights_until[left, i]
        for j in range(v.lefts.shape[1]):
            b, b_until = v.lefts[right, j], v.lefts_until[right, j]
            test = np.flatnonzero(good & (a >= 0) & (b >= 0))
            if not len(test):
                break
            place, known = _lookup(v.pair_keys, a[test].astype(np.int64) << 32 | b[test])
            rank = v.pair_ranks[place]
            # Of equal ranks the leftmost is merged first: inside the left token, but before the right one.
            good[test[known & (rank < a_until[test]) & (rank <= b_until[test])]] = False
    return good


def merge(piece: bytes, single: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """The tokens of a piece by merging, lowest rank first, leftmost first among equals."""
    tokens = [single[byte] for byte in piece]
    n = len(tokens)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (hit := ranks.get(tokens[i] << 32 | tokens[j])):
            heapq.heappush(queue, (hit[0], i, tokens[i], tokens[j], hit[1]))

    queue: list[tuple[int, int, int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, a, b, whole = heapq.heappop(queue)
        j = after[i]
        if tokens[i] != a or j >= n or tokens[j] != b:
            continue
        tokens[i], tokens[j] = whole, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [t for t in tokens if t >= 0]


def merge_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of many pieces by merging, as (tokens, number by piece); every round does the next merge of each piece."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    tokens = v.byte_tokens[data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))]]
    done_owner, done_tokens = [], []
    rank, whole = np.full(len(tokens), NEVER, dtype=np.int32), np.full(len(tokens), -1)
    stale = np.arange(len(tokens) - 1)
    while len(tokens):
        stale = stale[owner[stale] == owner[stale + 1]]
        place, known = _lookup(v.pair_keys, tokens[stale] << 32 | tokens[stale + 1])
        rank[stale] = np.where(known, v.pair_ranks[place], NEVER)
        whole[stale] = v.pair_merged[place]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        spread = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
        at = np.flatnonzero((rank == spread) & (spread < NEVER))
        if len(at):  # of overlapping equal pairs every second one, from the left
            begins = np.concatenate([[True], np.diff(at) > 1])
            run = np.flatnonzero(begins)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        tokens[at] = whole[at]
        rank[at] = NEVER
        keep = spread < NEVER
        done_owner.append(owner[~keep])
        done_tokens.append(tokens[~keep])
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        fresh = moved[at]
        owner, tokens, rank, whole = owner[keep], tokens[keep], rank[keep], whole[keep]
        rank[fresh] = NEVER
        before = fresh[fresh > 0] - 1
        before = before[owner[before] == owner[before + 1]] if len(before) else before
        rank[before] = NEVER
        stale = np.union1d(before, fresh[fresh < len(tokens) - 1])
    owner, tokens = np.concatenate(done_owner), np.concatenate(done_tokens)
    order = np.argsort(owner, kind="stable")
    return tokens[order], np.bincount(owner, minlength=len(starts))


class Encoder:
    """Encodes slices of texts; remembers the tokens of the pieces it has seen, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.single = vocabulary.byte_tokens.tolist()
        self.forget()

    @cached_property
    def ranks(self) -> dict[int, tuple[int, int]]:
        """Rank and result of every mergeable pair; made when the first long piece fails."""
        v = self.v
        return dict(zip(v.pair_keys.tolist(), zip(v.pair_ranks.tolist(), v.pair_merged.tolist(), strict=True), strict=True))

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int64)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encode new distinct pieces and remember them."""
        owner, tokens = propose(data, starts, ends, self.v)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, place = np.unique(tokens[same] << 32 | tokens[same + 1], return_inverse=True)
        failing = np.unique(owner[same[~compatible(pairs >> 32, pairs & 0xFFFFFFFF, self.v)[place]]])
        counts = np.bincount(owner, minlength=len(starts))
        bad = np.zeros(len(starts), dtype=bool)
        bad[failing] = True
        good_counts = np.where(bad, 0, counts)
        pool = [tokens[~bad[owner]]]
        first = np.cumsum(good_counts) - good_counts
        long = ends[failing] - starts[failing] > SHORT
        for group in (failing[~long], failing[long]):
            if not len(group):
                continue
            if ends[group[0]] - starts[group[0]] <= SHORT:
                merged, sizes = merge_many(data, starts[group], ends[group], self.v)
            else:
                each = [merge(data[starts[i] : ends[i]].tobytes(), self.single, self.ranks) for i in group.tolist()]
                merged, sizes = np.concatenate([np.array(m, dtype=np.int64) for m in each]), np.array([len(m) for m in each])
            first[group] = sum(map(len, pool)) + np.cumsum(sizes) - sizes
            good_counts[group] = sizes
            pool.append(merged)
        self.hashes = np.concatenate([self.hashes, hashes])
        self.first = np.concatenate([self.first, first + len(self.pool)])
        self.count = np.concatenate([self.count, good_counts])
        self.pool = np.concatenate([self.pool, *pool])
        order = np.argsort(self.hashes)
        self.hashes, self.first, self.count = self.hashes[order], self.first[order], self.count[order]

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts of a slice, and their offsets by text."""
        starts, special = cut_pieces(part, self.v)
        n_rows = part.last - part.first
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64)
        ends = np.append(starts[1:], len(part.data))
        hashes = span_hashes(part.data, starts, SPAN_TABLE)
        distinct, example, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        new = ~_lookup(self.hashes, distinct)[1] if len(self.hashes) else np.ones(len(distinct), dtype=bool)
        if new.any():
            self.learn(part.data, starts[example[new]], ends[example[new]], distinct[new])
        at, _ = _lookup(self.hashes, distinct)
        first, count = self.first[at][place], self.count[at][place]
        count = np.where(special >= 0, 1, count)
        total = np.cumsum(count)
        ids = self.pool[np.repeat(first - (total - count), count) + np.arange(total[-1])] if len(self.pool) else np.zeros(total[-1], np.int64)
        ids[(total - count)[special >= 0]] = special[special >= 0]
        bounds = np.concatenate([[0], total])[np.searchsorted(starts, part.offsets)]
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids; bytes that aren't UTF-8 become replacement characters."""
        begin, end = self.v.token_offsets[ids], self.v.token_offsets[ids + 1]
        sizes = end - begin
        total = np.concatenate([[0], np.cumsum(sizes)])
        data = self.v.token_bytes[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])].tobytes()
        edges = total[bounds]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def round_trip(docs: DataFrame, path: str, text_col: str = "text", decoded: bool = True) -> DataFrame:
    """The columns of `docs`, `ids` (packed little-endian unsigned 32-bit token ids) and `decoded`, the ids' text.

    A NULL text is empty and has no ids. Added tokens that stand in a text become their ids. Repeated rows are encoded
    each; all other columns are carried along, whatever their names but these two. An empty table gives an empty result.
    """
    vocabulary = load_vocabulary(path)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in text_slices(batch.column(text_col), PART_BYTES):
                n = part.last - part.first
                ids, bounds = encoder.encode(part)
                packed = ids.astype("<u4").tobytes()
                runs = [packed[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [batch.column(c).slice(part.first, n) for c in names] + [pa.array(runs, pa.binary())]
                if decoded:
                    columns.append(pa.array(encoder.decode(ids, bounds), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", *["decoded"] * decoded])

    fields = [*docs.schema.fields, T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.StringType())] * decoded]
    return docs.mapInArrow(freed(run), T.StructType(fields))


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The columns of `df` and `decoded`, the text of packed ids; NULL ids are an empty text."""
    vocabulary = load_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            runs = [np.frombuffer(x or b"", dtype="<u4").astype(np.int64) for x in batch.column(ids_col).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
            texts = encoder.decode(np.concatenate(runs) if runs else np.zeros(0, np.int64), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*df.columns, "decoded"])

    return df.mapInArrow(freed(run), T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))
