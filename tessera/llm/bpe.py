"""Byte-level BPE encoding and decoding.

Each match of the split pattern is encoded on its own.  Its bytes are leaves of
a segment tree that stores, per node, the leftmost position with the smallest
rank of (token, next live token); the root names the next merge.  A merge joins
a position with its live right neighbour and updates three leaves, so a piece of
n bytes costs O(n log n) even without any white space in megabytes of text.

Texts are encoded where they lie, without an exchange.  Encoded pieces are
remembered per Python worker in two generations of about ``REMEMBERED`` pieces,
which bounds the memory and changes no result.  New pieces of up to ``WIDEST``
bytes are merged together, one tree per row of an array; longer ones singly.

Defined results: a null text is empty and has no tokens; lone surrogates cannot
occur in Spark strings; repeated rows are encoded each; an empty table gives no
rows; input columns not named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_package

REMEMBERED = 150_000
WIDEST = 64
AT_ONCE = 4096
TOGETHER = 1_000_000
ROWS_OUT = 256
NONE = 1 << 60
#: Codecs of this Python worker by (vocabulary digest, pattern), so tasks share remembered pieces.
_CODECS: dict[tuple[str, str], Codec] = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: repeatedly join the leftmost pair of smallest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    lookup, size = ranks.get, 1 << (n - 1).bit_length()
    token = [piece[i : i + 1] for i in range(n)]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    # a node holds rank * size + position, so the smaller of two nodes is the leftmost smallest rank
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = lookup(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while tree[1] < NONE:
        i = tree[1] & (size - 1)
        j = right[i]
        joined = token[i] = token[i] + token[j]
        right[i] = after = right[j]
        changes = [(j, None)]
        if after < n:
            left[after] = i
            changes.append((i, lookup(joined + token[after])))
        else:
            changes.append((i, None))
        before = left[i]
        if before >= 0:
            changes.append((before, lookup(token[before] + joined)))
        for i, rank in changes:
            k, value = size + i, NONE if rank is None else rank * size + i
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                value = other if other < value else value
                if tree[k] == value:
                    break
                tree[k] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i]])
        i = right[i]
    return out


class PairRanks:
    """Rank of the token that two token ids form, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array([*sorted(pairs), 1 << 62], dtype=np.int64)
        self.ranks = np.array([*(pairs[k] for k in sorted(pairs)), 0], dtype=np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, or NONE; an id of -1 forms no token."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)


def merge_pieces(pieces: list[bytes], width: int, byte_ids: np.ndarray, pair_ranks: PairRanks) -> list[bytes]:
    """Ids of many pieces of at most ``width`` (a power of two) bytes, as little-endian bytes.

    One segment tree per row of ``tree``; every step makes the next merge of every
    piece that has one left.
    """
    m, bits = len(pieces), width.bit_length() - 1
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(m, width)
    token = np.full((m, width + 1), -1, dtype=np.int64)  # the last column stands for "no neighbour"
    token[:, :width] = np.where(np.arange(width) < lengths[:, None], byte_ids[raw], -1)
    right = np.tile(np.arange(1, width + 2), (m, 1))
    left = np.tile(np.arange(-1, width), (m, 1))
    left[:, 0] = width
    tree = np.full((m, 2 * width), NONE, dtype=np.int64)
    rank = pair_ranks(token[:, :-1], token[:, 1:])
    tree[:, width:] = np.where(rank < NONE, rank * width + np.arange(width), NONE)
    for level in range(bits - 1, -1, -1):
        lo, hi = 1 << level, 2 << level
        tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
    r = np.flatnonzero(tree[:, 1] < NONE)
    while len(r):
        root = tree[r, 1]
        i = root & (width - 1)
        j = right[r, i]
        token[r, i] = made = root >> bits  # a token's id is its rank
        token[r, j] = -1
        after = right[r, j]
        right[r, i] = after
        after = np.minimum(after, width)
        left[r, after] = i
        before = left[r, i]
        new_i, new_before = pair_ranks(made, token[r, after]), pair_ranks(token[r, before], made)
        tree[r, width + j] = NONE
        tree[r, width + i] = np.where(new_i < NONE, new_i * width + i, NONE)
        has = before < width
        tree[r[has], width + before[has]] = np.where(new_before < NONE, new_before * width + before, NONE)[has]
        spots = [j + width, i + width, np.where(has, before, i) + width]
        for _ in range(bits):
            spots = [k >> 1 for k in spots]
            for k in spots:
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
        r = r[tree[r, 1] < NONE]
    token = token[:, :width]
    live = token >= 0
    ids, ends = token[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encoder and decoder of one rank file and split pattern; ids are little-endian 32-bit bytes."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = parse_ranks(data)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pair_ranks = PairRanks(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not remembered, those of like size together."""
        old, classes = self.old, {}
        for piece in pieces:
            ids = old.get(piece)
            if ids is not None:
                self.young[piece] = ids
                continue
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self.young[piece] = whole.to_bytes(4, "little")
            elif len(data) > WIDEST:
                self.young[piece] = np.array(merge_piece(data, self.ranks), dtype="<u4").tobytes()
            else:
                classes.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for width, members in classes.items():
            for at in range(0, len(members), AT_ONCE):
                some = members[at : at + AT_ONCE]
                self.young.update(zip((p for p, _ in some), merge_pieces([d for _, d in some], width, self.byte_ids, self.pair_ranks)))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; texts are taken together up to ``TOGETHER`` characters."""
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= TOGETHER):
                chars += len(texts[stop])
                stop += 1
            pieces = [self.split(t) for t in texts[start:stop]]
            self.learn(set().union(*pieces).difference(self.young))
            ids_of = self.young.__getitem__
            for some in pieces:
                yield b"".join(map(ids_of, some))
            if len(self.young) >= REMEMBERED:
                self.young, self.old = {}, self.young
            start = stop

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_all([text])), dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec_of(data: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (if kept), ids_sha256, decoded_sha256.

    ``vocabulary`` is the path of a rank file on the driver; its bytes, whose size
    the vocabulary fixes, are broadcast.
    """
    ship_package(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = "doc_id bigint, n_tokens bigint, " + "ids array<int>, " * keep_ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(shared.value, pattern)
        names = [c.split()[0] for c in fields.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch["doc_id"].to_numpy(dtype=object), codec.encode_all(batch["text"].tolist())):
                ids = np.frombuffer(data, dtype="<u4")
                decoded = codec.decode(ids.tolist())
                rows.append((doc_id, len(ids), *([ids.astype("int32")] if keep_ids else []), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                if len(rows) == ROWS_OUT:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen.mapInPandas(run, fields)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the bytes that the ids stand for."""
    ship_package(encoded.sparkSession)
    with open(vocabulary, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def to_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = {i: t for t, i in parse_ranks(shared.value).items()}
        for ids in batches:
            yield ids.map(lambda a: None if a is None else b"".join([tokens[i] for i in a.tolist()]))

    return encoded.withColumn("decoded", to_bytes(ids_col))
