"""Centroid clustering, piece encoding and spelling variants against plain Python and the public library."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import centroids, pieces, queries, spelling

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def clusters_by_hand(rows, k=16, rounds=3):
    """(vec_id, cluster, distance) by full distances in Python integers, and the final centroids."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seed = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    points = [q for _, q in sorted(kept, key=seed)[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, p)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, q in kept:
            members[nearest(q)[1]].append(q)
        points = [[sum(col) // len(members[c]) for col in zip(*members[c])] if members[c] else p for c, p in enumerate(points)]
    return [(i, nearest(q)[1], nearest(q)[0]) for i, q in kept], points


def check_clusters(out, rows):
    want, points = clusters_by_hand(rows)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in out) == sorted((str(i), c, d) for i, c, d in want)
    own = Counter()
    for _, c, d in want:
        own[c] += d
    for r in out:
        assert (r.cluster_inertia, r.inertia) == (own[r.cluster], sum(own.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, points[r.cluster])).encode()).hexdigest()


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(20)] + [(7, rows[7][1]), (7, [0.5] * 64), (None, [0.25] * 64), (None, [-0.25] * 64)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [math.nan] + [1.0] * 63), (206, [math.inf] + [1.0] * 63)]
    rows += [(300, [1e6] + [0.0] * 63), (301, [-1e6] + [0.0] * 63), (302, [float(2**30)] * 64), (303, [0.0] * 64)]
    schema = "vec_id bigint, embedding array<double>, label int, q string, cluster string"
    df = spark.createDataFrame([(i, v, 1, "q", "c") for i, v in rows], schema).repartition(3)
    check_clusters(centroids.cluster(df).collect(), rows)
    check_clusters(centroids.cluster(df.where("vec_id < 5")).collect(), [r for r in rows if r[0] is not None and r[0] < 5])
    assert centroids.cluster(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id bigint, embedding array<double>")
    assert {r.vec_id: r.distance for r in centroids.cluster(huge, k=1).collect()}.keys() == {1, 2, 3}


def test_progressive_search_is_exact_and_drops_centroids():
    rng = np.random.default_rng(2)
    middles = rng.integers(-40, 40, (16, 64))
    rows = middles[rng.integers(0, 16, 500)] + rng.integers(-3, 4, (500, 64))
    rows[:20] = (middles[0] + middles[1]) // 2
    at, distance, seen = centroids.nearest(centroids.transform(rows), centroids.transform(middles))
    full = ((rows[:, None] - middles[None]) ** 2).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (distance == 64 * full.min(axis=1)).all()
    assert seen.mean() < 16 * 64 / 3
    one = [int(v) for v in rows[0]]
    assert centroids.inverse([int(v) for v in centroids.transform(rows[:1])[0]]) == one
    ties = np.repeat(middles[:1], 4, axis=0)
    assert (centroids.nearest(centroids.transform(rows), centroids.transform(ties))[0] == 0).all()


def odd_texts():
    rng = random.Random(7)
    parts = ["a", "b", "é", " ", "  ", "\n", "漢", "1", "!", "🙂", "the", "ing", "▁", "\t", "<s>", "\0", "ﬁ", "tion", "   ", "<0x41>", "�"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    return [*texts, "ab" * 20_000, " " * 1001, "z" * 70, "é" * 33, " " * 40 + "x", "\n" * 50]


def test_pieces_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = pieces.Codec(pieces.read_vocabulary(MODEL))
    for text, (ids, said, shown) in zip(odd_texts(), codec.encode_all(odd_texts())):
        want = library.encode(text)
        assert np.frombuffer(ids, dtype="<i4").tolist() == want and said.decode() == ",".join(map(str, want))
        assert shown.decode() == codec.decode(want) == library.decode(want)
    for text in odd_texts()[:300]:
        for chunk in codec.cut("▁" + text.replace(" ", "▁")):
            if chunk.count("▁") < 2 and len(chunk) <= pieces.WIDEST:
                assert codec.segment(chunk) == codec.segment_together([chunk], pieces.WIDEST)[0]
    rng = random.Random(9)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 260), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_a_chunk_is_segmented_once():
    codec = pieces.Codec(pieces.read_vocabulary(MODEL))
    seen = Counter()
    plain = codec.segment_together
    codec.segment_together = lambda chunks, width: seen.update(chunks) or plain(chunks, width)
    list(codec.encode_all(["one two two\nthree"] * 50 + ["two one"] * 50))
    assert seen == {"▁one": 1, "▁two": 1, "\n": 1, "three": 1}


def test_piece_query_and_odd_documents(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op12_sentence_pieces"](spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = pieces.decode(pieces.encode(odd_docs, MODEL), MODEL).collect()
    assert sorted(r.decoded for r in back) == sorted(library.decode(library.encode(r.text or "")) for r in odd_docs.collect())
    assert pieces.encode(no_docs, MODEL).count() == 0


def words_by_hand(rows):
    counts, lower = Counter(), str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def variants_by_hand(counts):
    """All rows, by every deletion of every word: words one edit apart share a word or a word with one place left open."""
    holed = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            holed[w[:k] + "\0" + w[k + 1 :]].add(w)
    near = {w: set() for w in counts}
    for w in counts:
        for k in range(len(w)):
            near[w] |= holed[w[:k] + "\0" + w[k + 1 :]] - {w}
            shorter = w[:k] + w[k + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, others in near.items():
        best = min(((-counts[o], o) for o in others), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * counts[w] else None
    root = {}
    for w in counts:
        root[w] = w
        while form[root[w]] is not None:
            root[w] = form[root[w]]
    return sorted((w, form[w] or "", root[w], n, len(near[w]), counts[form[w]] if form[w] else 0) for w, n in counts.items())


def check_variants(out, counts):
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in out) == variants_by_hand(counts)


@pytest.mark.parametrize("hot", [spelling.HOT, 3])
def test_variants_of_the_table(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_variants(queries.QUERIES["op13_spelling_variants"](spark, SF).collect(), words_by_hand(rows))


def test_variants_of_made_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT", 20)
    rng = random.Random(4)
    words = {"".join(rng.choice("aab") for _ in range(rng.randint(7, 9))) for _ in range(600)}
    words |= {"prefixed" + a + b for a in "abcdefghij" for b in "abcdefghij"} | {"é" * n for n in range(7, 12)} | {"x" * 300, "x" * 299, "x" * 301}
    rows = [(None, (w + " ") * rng.choice([1, 2, 3, 20, 40, 400])) for w in sorted(words)] + [(1, None), (2, ""), (2, "Straße×naïve STRAßE×NAïVE"), (3, "short words only")]
    schema = "doc_id bigint, text string, word string, n string, key string, role string"
    df = spark.createDataFrame([(i, t, "w", "n", "k", "r") for i, t in rows], schema).repartition(3)
    check_variants(spelling.variants(df).collect(), words_by_hand(rows))
    assert spelling.variants(df.limit(0)).count() == 0


def test_join_keys_stay_small(spark):
    """A hot chunk is made longer until few rows share it: candidates grow with the words, not with the square of a group."""
    letters = "abcdefghijklmnopqrst"
    words = [("international" + a + b + c + "isation", 2) for a in letters for b in letters for c in letters[:5]]
    made = spelling._chunks_and_grams(spark.createDataFrame(words, "word string, n bigint"))
    assert made.groupBy("key").count().agg({"count": "max"}).first()[0] > 10 * spelling.HOT
    pairs = spelling.near_pairs(spark.createDataFrame(words, "word string, n bigint"))
    assert pairs.count() == len(words) * (19 + 19 + 4)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("side", "w4")]
    assert {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {w: "w9" for w, _ in chain}
