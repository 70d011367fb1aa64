"""Near-duplicates of texts and vectors, and page extraction, against brute force."""

import html
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lattice, near_dedup, pages, queries, shingles
from tessera.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else set(zip(*[w[i:] for i in range(5)]))


def brute_texts(texts):
    sets = [brute_shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, groups(len(sets), links)


def check_texts(rows, texts, ids):
    sets, root = brute_texts(texts)
    assert len(rows) == len(texts)
    for r, i, s, g in zip(sorted(rows, key=lambda r: r.doc_id), ids, sets, root):
        assert (r.doc_id, r.n_shingles, r.component_id, r.kept) == (i, len(s), ids[g], ids[g] == i)


def test_near_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    check_texts(queries.QUERIES["op7_minhash_near_dedup"](spark, SF).collect(), [r.text for r in docs], [r.doc_id for r in docs])


def chained_texts():
    """Copies, chains of near copies (ends unlike), a crowd below the threshold, short texts."""
    rng = random.Random(5)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    out, base = [], words(120)
    for k in range(60):
        base = base[:]
        base[(k * 7) % 120] = f"new{k}"
        out.append(" ".join(base))
    common = words(80)
    out += [" ".join(common + words(45)) for _ in range(60)] + [" ".join(common + words(12)) for _ in range(30)]
    out += ["Same Text Here", "same text here", "other text", "", None, "a b c d", "a b c d e"] + out[:5]
    return out


def test_chains_and_crowds(spark, monkeypatch):
    texts = chained_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    check_texts(near_dedup.near_groups(df).collect(), texts, list(range(len(texts))))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    check_texts(near_dedup.near_groups(df).collect(), texts, list(range(len(texts))))


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    rows = near_dedup.near_groups(odd_docs, carry=("doc_id", "text", "size")).collect()
    sets = {}
    for r in rows:
        sets.setdefault(frozenset(brute_shingles(r.carried.text)), []).append(r)
    assert len(rows) == odd_docs.count()
    for s, members in sets.items():
        assert all(r.n_shingles == len(s) for r in members)
        if not s:
            assert all(r.stays and r.component_id == r.doc_id for r in members)
    by = {}
    for r in rows:
        by.setdefault(r.component_id if r.n_shingles and r.component_id is not None else id(r), []).append(r)
    assert all(sum(r.stays for r in m) == 1 for m in by.values())
    assert near_dedup.near_groups(no_docs).count() == 0


def test_sketch_estimates_and_bands():
    rng = np.random.default_rng(1)
    for share in (0.75, 0.85, 0.95):
        far, missed = 0, 0
        for _ in range(300):
            n = 400
            k = int(round(2 * n * share / (1 + share)))
            both, a, b = (rng.integers(0, 1 << 63, m).astype(np.uint64) for m in (k, n - k, n - k))
            x, y = (shingles.signature(np.unique(np.concatenate([both, z]))) for z in (a, b))
            far += np.bitwise_count((shingles.odd_sketch(x) ^ shingles.odd_sketch(y)).view(np.uint64)).sum() > shingles.most_odd_bits(0.75)
            missed += not (shingles.band_keys(x) == shingles.band_keys(y)).any()
        assert far == 0 and missed <= 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = groups(400, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert set(out) == touched and all(out[x] == want[x] for x in touched)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_vectors(rows):
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a, b in itertools.combinations(ok, 2):
        (_, x, p), (_, y, q) = rows[a], rows[b]
        if p == q and len(x) == len(y):
            x, y = np.float64(x), np.float64(y)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((a, b))
    return links


def check_vectors(out, rows, least=1.0):
    links = brute_vectors(rows)
    found = sum(r.n_links for r in out) / 2
    assert len(out) == len(rows) and least * len(links) <= found <= len(links)
    return links


def test_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in table]
    out = sorted(queries.QUERIES["op8_lattice_near_dedup"](spark, SF).collect(), key=lambda r: r.vec_id)
    links = check_vectors(out, rows, 0.99)
    degree = np.bincount([x for p in links for x in p], minlength=len(rows))
    if sum(r.n_links for r in out) == 2 * len(links):
        root = groups(len(rows), links)
        assert [(r.n_links, r.component_id) for r in out] == [(d, rows[g][0]) for d, g in zip(degree, root)]


def test_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    center = rng.normal(size=16)
    rows = [(k, (center + 0.02 * rng.normal(size=16)).tolist(), 1) for k in range(60)] + [(100 + k, rng.normal(size=16).tolist(), k % 2) for k in range(40)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [float("inf")] + [1.0] * 15, 1), (205, [None] + [1.0] * 15, 1), (206, center.tolist(), None), (207, [1.0, 2.0], 1), (208, [1.0, 2.0], 1), (208, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (209, (1e30 * center).tolist(), 1), (210, (1e-30 * center).tolist(), 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, row string")
    for block in (512, 7):
        monkeypatch.setattr(lattice, "BLOCK", block)
        out = lattice.near_vectors(df).collect()
        check_vectors(out, rows, 0.97)
        assert sum(r.stays for r in out if r.component_id == 0) == 1
        assert sum(r.n_links for r in out if r.vec_id is not None and 200 <= r.vec_id < 207) == 0
        assert sorted((r.vec_id or -1, r.component_id, r.n_links) for r in out if r.vec_id in (207, 208, None)) == [(-1, 207, 3), (207, 207, 3), (208, 207, 3), (208, 207, 3)]
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_copies_of_a_vector_are_one_node(spark, monkeypatch):
    rng = np.random.default_rng(11)
    a, c = rng.normal(size=12), rng.normal(size=12)
    b = a + 0.005 * rng.normal(size=12)
    made = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0).when(F.col("id") < 12_000, 1).otherwise(2).alias("which"))
    pool = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in (a, b, c)])
    df = made.select(F.col("id").alias("vec_id"), F.element_at(pool, F.col("which") + 1).alias("embedding"), F.when(F.col("id") != 7, 1).alias("label"))
    visits, keep = [], lattice.materialise

    def watched(table):
        out = keep(table)
        visits.extend([out.count()] if "home" in out.columns else [])
        return out

    monkeypatch.setattr(lattice, "materialise", watched)
    got = lattice.near_vectors(df).groupBy((F.col("vec_id") % 2 == 0).alias("even"), (F.col("vec_id") < 12_000).alias("low"), "n_links", "component_id").count()
    got = {tuple(r) for r in got.collect()}
    # 10,000 rows of a and 5,999 of b link with each other, 4,000 rows of c among themselves, row 7 has no label
    assert got == {(True, True, 15_998, 0, 6_000), (True, False, 15_998, 0, 4_000), (False, True, 15_998, 0, 5_999), (False, True, 0, 7, 1), (False, False, 3_999, 12_001, 4_000)}
    assert sum(visits) <= 2 * lattice.TABLES * (1 + lattice.PROBES)


def test_lattice_points():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest_point(y)
    twice = np.rint(2 * p).astype(int)
    assert (2 * p == twice).all() and ((twice % 2 == 0).all(axis=1) | (twice % 2 == 1).all(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    near = ((y[:, None, :] - (p[:, None, :] + lattice.NEIGHBOURS[None])) ** 2).sum(axis=2).min(axis=1)
    assert (((y - p) ** 2).sum(axis=1) <= near + 1e-9).all() and len(lattice.NEIGHBOURS) == 240


def longest(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        s = [x for x, f in zip(a, pages.aligned(a, b)) if f >= 0]
        rest = iter(b)
        assert len(s) == longest(a, b) and all(x in rest for x in s)


def test_pages_of_the_table(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.QUERIES["op9_html_extraction"](spark, SF).collect()
    assert len(out) == len(rows)
    for r in out:
        article = re.search(r"<article>(.*?)</article>", rows[r.page_id].html, re.S)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article[1])).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><div class='cookie-notice'>We use</div><p>One &amp; <b>t</b>wo<p>three<div id=comments><p>c</div><aside>s</aside>four<form>f<input></form></body>", "One & two three four"),
        ("<main><h1>T</h1><p class=ad>buy<p>text<br>more</main><footer>f</footer>", "T text more"),
        ("<nav><ul><li>a</ul><article>x &lt;y&gt;<script>if (a<b) '</p>'</script> z</article>", "x <y> z"),
        ("<article>a<article class='comment'>no</article>b", "a b"),
        ("plain text only", "plain text only"),
        ("<div class=ad>never closed<article><p>kept", "kept"),
        ("<p>cut in a ta<b", "cut in a ta"),
        ("", ""),
    ],
)
def test_markup(page, text):
    assert pages.main_text(pages.page_lines(page), None) == text


def test_pages_differ_from_their_neighbours(spark):
    plain = "<p>Site name</p><p>{}</p><p>All rights reserved</p>"
    rows = [(k, f"https://h.example/a/{k}", plain.format(f"story {k}")) for k in range(6)] + [(10, "https://one.example/x", plain.format("alone")), (11, None, "<p>u</p>"), (12, "https://h.example/z", None), (13, "h", "<p>odd</p>")]
    rows += [(20 + k, f"https://c.example/{k}", "<article>one article</article>") for k in range(2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")
    out = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert len(out) == len(rows) and all(out[k] == f"story {k}" for k in range(6))
    assert out[10] == "Site name alone All rights reserved" and out[11] == "u" and out[12] == "" and out[13] == "odd" and out[20] == out[21] == "one article"
    assert pages.extract(df.limit(0)).count() == 0
