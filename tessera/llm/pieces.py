"""SentencePiece (BPE with byte fallback) encoding and decoding by a distinct-chunk table.

A text is marked: a space becomes the marker, and one marker is put in front.  No
piece of the vocabulary has a marker after another character, and characters
that no longer piece contains never merge; so the marked text is cut before every run of
markers and around runs of such characters, and chunks can be segmented on their own.
Each distinct chunk of a block of texts is segmented once, many chunks of like
length per array step, and its ids (and what they decode to) are joined back by
position.

The table is kept per Python worker, in two generations of about ``REMEMBERED``
chunks, which bounds its memory and changes no result; a table of the whole corpus
would send every word position through two exchanges.  Texts are encoded where
they lie.

Defined results: a null text is empty and has no ids; the marker itself in a
text is taken as a space; repeated rows are encoded each; an empty table gives no rows;
input columns not named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_package

MARK = "▁"
REMEMBERED = 150_000
WIDEST = 32
AT_ONCE = 8192
TOGETHER = 1_000_000
ROWS_OUT = 256
FREE = np.int32(1 << 30)
UNKNOWN_SHOWN = " ⁇ "
#: Codecs of this Python worker by vocabulary digest, so tasks share remembered chunks.
_CODECS: dict[str, Codec] = {}


def read_vocabulary(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id of a model file; kinds: piece, byte, control, unknown.

    Only models of the form that this module implements are taken: byte fallback,
    text otherwise unchanged but for a marker in front, no reserved or unused pieces.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    odd = "  ﬁ Ａé  "
    if model.normalize(odd) != MARK + odd.replace(" ", MARK):
        raise ValueError(f"{path}: normalises text in another way")
    out = []
    for i in range(model.get_piece_size()):
        kind = "byte" if model.is_byte(i) else "control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "piece"
        if model.is_unused(i):
            raise ValueError(f"{path}: unused pieces")
        out.append((model.id_to_piece(i), model.get_score(i), kind))
    return out


class Pairs:
    """Merge rank of the piece that two symbols form, for arrays of symbols; a hash table with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, FREE, dtype=np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        ranks = np.array(list(pairs.values()), dtype=np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], ranks[put]
            left = np.setdiff1d(np.arange(len(keys)), put)
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & (len(self.keys) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, or FREE; a negative symbol forms no piece."""
        keys = a.astype(np.int64) << 32 | b
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), FREE, dtype=np.int32)
        todo = np.flatnonzero((keys >= 0) & (b.ravel() >= 0))
        at = self._slot(keys[todo])
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
            if not len(todo):
                break
        return out.reshape(shape)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.vocabulary = vocabulary
        self.ids = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == "piece"}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        self.raw = set(self.byte_ids.values())
        self.said_of = [f"{i},".encode() for i in range(len(vocabulary))]
        self.text_of = [p.replace(MARK, " ").encode() if kind == "piece" else UNKNOWN_SHOWN.encode() if kind == "unknown" else b"" for p, _, kind in vocabulary]
        scores = sorted({vocabulary[i][1] for i in self.ids.values()}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.rank = {p: order[vocabulary[i][1]] for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a marker after another character")
        joining = sorted({ch for p in self.ids if len(p) > 1 for ch in p} - {MARK})
        chars = "".join(map(re.escape, joining))
        self.cut = re.compile(f"{MARK}*[{chars}]+|{MARK}+|[^{MARK}{chars}]+").findall
        # symbols of the array form: pieces by id, single characters that are no piece after them; ranks shared by pieces stay out of it
        times = Counter(self.rank[p] for p in self.ids if len(p) > 1)
        self.loose = {p for p in self.ids if len(p) > 1 and times[self.rank[p]] > 1}
        self.symbols = dict(self.ids)
        for ch in {ch for p in self.ids for ch in p}:
            self.symbols.setdefault(ch, len(vocabulary) + len(self.symbols))
        self.of_code = np.full(0x110000, -2, dtype=np.int32)
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.of_code[ord(s)] = i
        pairs = {}
        for p in self.ids:
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None and p not in self.loose:
                    pairs[a, b] = self.rank[p]
        self.pairs = Pairs(pairs)
        self.made = np.zeros(len(scores), dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) > 1 and p not in self.loose:
                self.made[self.rank[p]] = i
        self.loose_chars = {ch for p in self.loose for ch in p}
        self.young: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes, bytes]] = {}

    def _ids_of(self, symbol: str) -> list[int]:
        i = self.ids.get(symbol)
        return [i] if i is not None else [self.byte_ids[b] for b in symbol.encode()]

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk: join the pair of best score, ties from the left, by a heap over live neighbours."""
        rank, token, n = self.rank, list(chunk), len(chunk)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(token[i] + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = right[i]
            if not token[i] or j == n or len(token[i]) + len(token[j]) != size or rank.get(token[i] + token[j]) != r:
                continue
            token[i] += token[j]
            token[j] = ""
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (r := rank.get(token[i] + token[after])) is not None:
                    heapq.heappush(heap, (r, i, len(token[i]) + len(token[after])))
            before = left[i]
            if before >= 0 and (r := rank.get(token[before] + token[i])) is not None:
                heapq.heappush(heap, (r, before, len(token[before]) + len(token[i])))
        return [i for t in token if t for i in self._ids_of(t)]

    def segment_together(self, chunks: list[str], width: int) -> list[list[int]]:
        """As ``segment``, for many chunks of at most ``width`` characters, one row of an array each."""
        m = len(chunks)
        lengths = np.array([len(c) for c in chunks])
        codes = np.frombuffer("".join(c.ljust(width, "\0") for c in chunks).encode("utf-32-le"), dtype=np.uint32).reshape(m, width)
        inside = np.arange(width) < lengths[:, None]
        token = np.full((m, width + 1), -1, dtype=np.int32)  # the last column stands for "no neighbour"
        token[:, :width] = np.where(inside, self.of_code[codes], -1)
        right = np.tile(np.arange(1, width + 2, dtype=np.int32), (m, 1))
        left = np.tile(np.arange(-1, width, dtype=np.int32), (m, 1))
        left[:, 0] = width
        rank = np.full((m, width + 1), FREE, dtype=np.int32)
        rank[:, :width] = self.pairs(token[:, :-1], token[:, 1:])
        r = np.arange(m)
        while len(r):
            mine = rank[r]
            i = mine.argmin(axis=1)
            best = mine[np.arange(len(r)), i]
            going = best < FREE
            r, i, best = r[going], i[going], best[going]
            j = right[r, i]
            token[r, i] = made = self.made[best]
            token[r, j] = -1
            after = np.minimum(right[r, j], width)
            right[r, i] = after
            left[r, after] = i
            before = left[r, i]
            rank[r, j] = FREE
            rank[r, i] = self.pairs(made, token[r, after])
            rank[r, before] = self.pairs(token[r, before], made)
            rank[r, width] = FREE
        live = inside & (token[:, :width] != -1)
        bare = (token[:, :width] < 0) | (token[:, :width] >= len(self.vocabulary))
        needs_bytes = (live & bare).any(axis=1)
        flat, ends = token[:, :width][live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for row in np.flatnonzero(needs_bytes):
            spots = np.flatnonzero(live[row])
            parts = [chunks[row][a:b] for a, b in zip(spots, [*spots[1:], len(chunks[row])])]
            out[row] = [i for part in parts for i in self._ids_of(part)]
        return out

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes, bytes]:
        """Ids as little-endian 32-bit bytes and as decimals with a comma after each, and the bytes that they decode to."""
        shown = b"".join(map(self.text_of.__getitem__, ids)) if self.raw.isdisjoint(ids) else self.shown(ids)
        return struct.pack(f"<{len(ids)}i", *ids), b"".join(map(self.said_of.__getitem__, ids)), shown

    def learn(self, chunks: set[str]) -> None:
        """Segment chunks not in the table, those of like length together."""
        old, classes, entry = self.old, {}, self._entry
        for chunk in chunks:
            known = old.get(chunk)
            if known is not None:
                self.young[chunk] = known
            elif len(chunk) > WIDEST or sum(map(chunk.count, self.loose_chars)) > 1:
                self.young[chunk] = entry(self.segment(chunk))
            else:
                classes.setdefault(max(4, 1 << (len(chunk) - 1).bit_length()), []).append(chunk)
        for width, members in classes.items():
            for at in range(0, len(members), AT_ONCE):
                some = members[at : at + AT_ONCE]
                self.young.update(zip(some, map(entry, self.segment_together(some, width))))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """Joined table entries of each text; texts are taken together up to ``TOGETHER`` characters."""
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= TOGETHER):
                chars += len(texts[stop])
                stop += 1
            chunks = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts[start:stop]]
            self.learn(set().union(*chunks).difference(self.young))
            look = self.young.__getitem__
            for some in chunks:
                ids, said, shown = zip(*map(look, some)) if some else ((), (), ())
                yield b"".join(ids), b"".join(said)[:-1], b"".join(shown)[1:]  # without the marker in front
            if len(self.young) >= REMEMBERED:
                self.young, self.old = {}, self.young
            start = stop

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_all([text]))[0], dtype="<i4").tolist()

    def shown(self, ids: list[int]) -> bytes:
        """What ids stand for, with the marker in front still a space; bytes that form no character each show as a replacement."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.raw:
                raw.append(int(self.vocabulary[i][0][3:5], 16))
                continue
            out += [_characters(bytes(raw)), self.text_of[i]]
            raw.clear()
        return b"".join([*out, _characters(bytes(raw))])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a marker that begins it is the one put in front."""
        seen = [self.vocabulary[i] for i in ids if self.vocabulary[i][2] != "control"]
        data = self.shown(ids)
        marked = bool(seen) and seen[0][2] == "piece" and seen[0][0].startswith(MARK)
        return data[marked:].decode()


def _characters(raw: bytes) -> bytes:
    """UTF-8 of a run of bytes, each byte that is part of no character replaced."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(raw[at : at + size])
            break
        else:
            size = 1
            out.append("�".encode())
        at += size
    return b"".join(out)


def codec_of(vocabulary: list[tuple[str, float, str]]) -> Codec:
    key = hashlib.sha256(repr(vocabulary).encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (if kept), ids_sha256, decoded_sha256.

    ``model`` is the path of a model file on the driver; its pieces, whose size
    the vocabulary fixes, are broadcast.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    fields = "doc_id bigint, n_tokens bigint, " + "ids array<int>, " * keep_ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(shared.value)
        names = [c.split()[0] for c in fields.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, (ids, said, shown) in zip(batch["doc_id"].to_numpy(dtype=object), codec.encode_all(batch["text"].tolist())):
                kept = [np.frombuffer(ids, dtype="<i4")] if keep_ids else []
                rows.append((doc_id, len(ids) // 4, *kept, hashlib.sha256(said).hexdigest(), hashlib.sha256(shown).hexdigest()))
                if len(rows) == ROWS_OUT:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen.mapInPandas(run, fields)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``: the text that the ids stand for."""
    ship_package(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    @F.pandas_udf("string")
    def to_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(shared.value)
        for ids in batches:
            yield ids.map(lambda a: None if a is None else codec.decode([int(i) for i in a]))

    return encoded.withColumn("decoded", to_text(ids_col))
