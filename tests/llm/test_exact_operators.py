"""Sharding, exact dedup, mixing, chat formatting and BPE against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, exact_dedup, mixing, queries, sharding
from tests.compare import connect, diff, oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    assert diff(spark_rows(queries.QUERIES[name](spark, SF)), oracle_rows(connect(SF), queries.ORACLES[name])) is None


def check_shards(rows, shards, texts, tolerance=0.01):
    total, by = sum(r.size for r in rows), defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    largest = max((r.size for r in rows), default=0)
    for members in by.values():
        assert abs(sum(r.size for r in members) - total / shards) <= 2 * max(tolerance * total / shards, largest)
        assert sorted(r.slot for r in members) == list(range(len(members)))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == want


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_shards(queries.QUERIES["op1_histogram_sharding"](spark, SF).collect(), 16, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_shards_keep_groups_where_they_fit_and_cut_hot_ones(spark):
    rows = [(i, f"text {i % 400} " + "y" * 40) for i in range(4000)] + [(i, "hot text " * 10) for i in range(4000, 6000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=4, tolerance=0.02).collect()
    check_shards(out, 4, rows, 0.02)
    homes = defaultdict(set)
    for r in out:
        homes[r.text_crc32].add(r.shard)
    assert len(homes[zlib.crc32(("hot text " * 10).encode())]) > 1
    assert sum(len(x) > 1 for x in homes.values()) <= 4


def test_shards_of_repeated_rows_are_cut_by_row(spark):
    out = sharding.shard_by_bytes(spark.createDataFrame([(7, "same")] * 3000, "doc_id bigint, text string"), shards=3).groupBy("shard").count().collect()
    assert len(out) == 3 and max(r["count"] for r in out) - min(r["count"] for r in out) <= 60


def test_odd_and_empty_documents(spark, odd_docs, no_docs, tmp_path):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    check_shards(sharding.shard_by_bytes(odd_docs, shards=3).collect(), 3, rows)
    assert sharding.shard_by_bytes(no_docs).count() == 0
    sharding.write_shards(odd_docs, str(tmp_path / "shards"), shards=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows) and set(odd_docs.columns) <= set(back.columns)

    out = exact_dedup.dedup(odd_docs).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(out) == len(rows) and sum(r.kept for r in out) == len(groups)
    for r in out:
        (text,) = [t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r.digest)]
        ids = [i for i in groups[text] if i is not None]
        assert r.keep_id == max(ids, default=None) and r.group_size == len(groups[text])
    assert exact_dedup.dedup(no_docs).count() == 0

    mixed = mixing.mix(odd_docs).collect()
    assert len(mixed) == len(rows)
    for r in mixed:
        assert r.taken == r.size * r.copies <= 2 * r.size and r.target <= 2 * r.source_size
    assert sorted(map(tuple, mixed), key=str) == sorted(map(tuple, mixing.mix(odd_docs.repartition(7)).collect()), key=str)
    assert mixing.mix(no_docs).count() == 0

    encoded = bpe.encode(odd_docs, VOCABULARY, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, VOCABULARY).collect()
    assert sorted(bytes(r.decoded).decode() for r in decoded) == sorted(t or "" for _, t in rows)
    assert bpe.encode(no_docs, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def join_sides(plan):
    """The two subtrees below the first sort-merge join of a plan's text."""
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    column = lines[at].index("SortMergeJoin")
    starts = [i for i in range(at + 1, len(lines)) if lines[i][column : column + 3] in (":- ", "+- ")][:2]
    return ["\n".join(lines[starts[0] : starts[1]]), "\n".join(lines[starts[1] :])]


def test_index_takes_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    batch = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    first = {r.doc_id: r for r in index.ingest(batch([(1, "a"), (2, "a"), (3, "b")])).collect()}
    assert [first[i].kept for i in (1, 2, 3)] == [False, True, True] and first[1].keep_id == 2
    index.close()
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    second = {r.doc_id: r for r in index.ingest(batch([(4, "b"), (5, "c"), (6, "c"), (7, "d")])).collect()}
    assert {i: r.kept for i, r in second.items()} == {4: False, 5: False, 6: True, 7: True} and second[4].keep_id == 3
    assert index.rows().count() == 4 and index.ingest(batch([])).count() == 0
    third = exact_dedup._digested(batch([(8, "b"), (9, "c"), (10, "new"), (11, "new")]), "doc_id", "text", ()).groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("copies"))
    for df in (index.fresh(third), index.held(third)):
        sides = join_sides(df._jdf.queryExecution().executedPlan().toString())
        (unmoved,) = [side for side in sides if "SelectedBucketsCount: 4 out of 4" in side]
        assert "Exchange" not in unmoved
    assert [r.top.doc_id for r in index.fresh(third).collect()] == [11]


def test_later_batches_lose_to_the_index(spark, monkeypatch):
    """The second batch of a table meets the digests of the first: its anti-join drops rows, and results do not depend on the batches."""
    offered, taken = [], []
    plain = exact_dedup.DigestIndex.fresh

    def counted(self, groups):
        out = plain(self, groups)
        offered.append(groups.count()), taken.append(out.count())
        return out

    monkeypatch.setattr(exact_dedup.DigestIndex, "fresh", counted)
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(200)] + [(None, "text 3"), (None, "alone")], "doc_id bigint, text string")
    out = [sorted(map(tuple, exact_dedup.dedup(docs, batches=n).collect()), key=str) for n in (1, 2, 5)]
    assert out[0] == out[1] == out[2]
    assert offered[1] == offered[2] - 1 == 40 and taken[:3] == [41, 40, 1] and all(t == 0 for t in taken[4:-1])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index") and spark.table(t.name).count() == 42]


def test_targets_share_the_excess():
    sizes, weights = {"a": 1000, "b": 50, "c": 400, None: 10}, (3, 1, 2)
    order = ["a", "b", "c", None]
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        left, share = total - sum(capped.values()), sum(w[s] for s in order if s not in capped)
        over = [s for s in order if s not in capped and left * w[s] / share > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2 * sizes[s] for s in over}
    want = {s: capped.get(s, left * w[s] / share) for s in order}
    from tessera.session import local_session

    got = mixing.targets(local_session().createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size bigint")).collect()
    assert {r.source: pytest.approx(r.target) for r in got} == want


def test_mix_comes_near_its_targets(spark):
    out = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for r in out.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 0.03 * r.target


def test_layouts_reach_the_same_turns(spark):
    q, a = "what <|im_end|> is <&| this?", "an answer\n</| with <&&/| marks"
    records = [
        '{"id": 1, "messages": [{"role": "user", "content": %s}, {"role": "assistant", "content": %s}]}',
        '{"id": 2, "conversations": [{"from": "human", "value": %s}, {"from": "gpt", "value": %s}]}',
        '{"id": 3, "prompt": %s, "completion": %s}',
        '{"prompt": %s, "response": %s, "id": 4}',
        '{"id": 5, "question": %s, "answer": %s}',
        '{"id": 6, "instruction": %s, "output": %s}',
        '{"id": 7, "instruction": %s, "input": "", "output": %s}',
    ]
    import json

    made = [(r % (json.dumps(q), json.dumps(a)),) for r in records] + [('{"id": 8, "other": 1}',), ('{"id": 9, "messages": [{"role": null, "content": null}]}',)]
    df = spark.createDataFrame(made, "j string").select(F.parse_json("j").alias("record"))
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.canonical_turns(df))).collect()}
    assert set(back) == {*range(1, 8), 9}
    for i in range(1, 8):
        assert [tuple(t) for t in back[i].turns] == [("user", q), ("assistant", a)] and back[i].loss_text == a
        assert back[i].formatted.count("<|") == 4
    assert [tuple(t) for t in back[9].turns] == [("", "")] and back[9].loss_text == ""
    assert chat.unmapped(df).count() == 1 and chat.canonical_turns(df.limit(0)).count() == 0


def test_roles_and_repeated_turns_come_back(spark):
    rows = [(1, 0, "us\ner</|", "x" * 20_000), (1, 1, "assistant", "<|im_start|>"), (1, 1, "assistant", "<|im_start|>"), (None, None, None, None), (2, 5, "assistant", "<")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert [tuple(t) for t in back[1].turns] == [(r, t) for _, _, r, t in rows[:3]] and back[1].loss_text == "<|im_start|>" * 2
    assert [tuple(t) for t in back[None].turns] == [("", "")] and back[2].loss_text == "<"


def test_ids_equal_the_library():
    codec = bpe.codec_of(open(VOCABULARY, "rb").read(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["a", "b", "é", " ", "  ", "\n", "漢", "1", "!", "🙂", "the", "ing", "'s", "\t", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(2000)] + ["ab" * 20_000, "z" * 70, "é" * 33]
    for text, data in zip(texts, codec.encode_all(texts)):
        want = library.encode_ordinary(text)
        assert [int.from_bytes(data[k : k + 4], "little") for k in range(0, len(data), 4)] == want
        assert codec.decode(want).decode() == text
    for text in texts[:200]:
        for piece in codec.split(text):
            assert bpe.merge_piece(piece.encode(), codec.ranks) == codec.encode(piece)


def test_bpe_query(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(open(VOCABULARY, "rb").read()), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op10_byte_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
