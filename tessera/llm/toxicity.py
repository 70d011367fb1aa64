"""Toxicity by a linear-chain conditional random field.

Labels are of documents, so tokens of the training sample are labelled first:
on one part of the sample, words and word beginnings are counted per class and
those that occur far more often in toxic documents form a lexicon; on the rest,
a token of a toxic document is offending when its lexicon level is high, all
other tokens are clean.  Because lexicon and field see different documents, the
field learns how far each level can be trusted.  The field has two states;
its features are the lexicon levels of a token's word and beginnings and the
token's shape.  Gradients are summed over the parts of the sample.

Each text is one chain, in training and in scoring.  It is laid out in rows of
``SEGMENT`` tokens, and messages are carried over the borders of its rows.  Marginals
from the forward-backward recursion are summed to document features, a logistic
curve turns those into a score, and runs of likely tokens are offending spans.

Labels come from at most ``SAMPLE`` rows; the held-out fold is never read.

Defined results: null texts are empty; empty texts have no tokens and get the
score of a clean document; without labels, or with one class only, every score
is that class's share (0 if there are no labels); repeated rows get equal
scores; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import training_sample
from tessera.session import materialise, ship_package

SAMPLE = 30_000
LEXICON_SHARE = 0.6
SEGMENT = 64
#: Least evidence (nats) of the lexicon levels 1, 2, ...; tokens from SEED on are labelled offending.
LEVELS = (4.0, 8.0, 14.0, 24.0, 40.0)
SEED = 3
STEPS = 40
PENALTY = 1.0
LIKELY = 0.5
REMEMBERED = 150_000
TOKEN = re.compile(r"[^\W_]+")
GRAMS = (4, 5)


def grams_of(word: str) -> list[str]:
    """A lower-cased word and its beginnings, marked by length."""
    return [word, *(f"{n}:{word[:n]}" for n in GRAMS if len(word) >= n)]


def evidence(k1, k0, n1: int, n0: int):
    """Nats by which k1 toxic and k0 clean documents speak for a toxic gram; 0 if they do not."""
    share, base = k1 / (k1 + k0), n1 / (n1 + n0)
    inside = k1 * np.log(share / base) + k0 * np.log(np.maximum(1 - share, 1e-12) / (1 - base))
    return np.where(share > base, inside, 0.0)


@dataclass
class Field:
    """Lexicon and weights; sizes are bounded by the training sample."""

    lexicon: dict[str, int] = field(default_factory=dict)
    codes: dict[tuple, int] = field(default_factory=dict)
    unary: np.ndarray = field(default_factory=lambda: np.zeros(0))
    between: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float | None = None

    def traits(self, word: str) -> tuple:
        """Lexicon level of the word and of its beginnings, and the word's shape."""
        low = word.lower()
        levels = [self.lexicon.get(g, 0) for g in grams_of(low)]
        shape = 2 if word.isupper() and len(word) > 1 else int(word[:1].isupper())
        return (levels[0], max(levels[1:], default=0), shape, min(len(low) // 4, 3))

    def code(self, word: str) -> int:
        return self.codes.setdefault(self.traits(word), len(self.codes))


def trait_rows(codes: dict[tuple, int]) -> np.ndarray:
    """One-hot features of each code: level of word, of beginnings, shape, length, constant."""
    sizes = (len(LEVELS) + 1, len(LEVELS) + 1, 3, 4)
    out = np.zeros((len(codes), sum(sizes) + 1))
    for t, c in codes.items():
        at = 0
        for v, s in zip(t, sizes):
            out[c, at + v] = 1
            at += s
        out[c, -1] = 1
    return out


def all_codes() -> dict[tuple, int]:
    n = len(LEVELS) + 1
    return {t: i for i, t in enumerate((a, b, s, m) for a in range(n) for b in range(n) for s in range(3) for m in range(4))}


def segments(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of several texts laid out in rows of SEGMENT; -1 pads.  Returns rows and owner of each row."""
    counts = [-(-len(c) // SEGMENT) for c in codes]
    out = np.full((sum(counts), SEGMENT), -1, dtype=np.int64)
    row = 0
    for c, k in zip(codes, counts):
        out[row : row + k].ravel()[: len(c)] = c
        row += k
    return out, np.repeat(np.arange(len(codes)), counts)


def continued(owner: np.ndarray) -> np.ndarray:
    """Whether each row goes on with the chain of the row before."""
    return np.concatenate([np.zeros(min(len(owner), 1), bool), owner[1:] == owner[:-1]])


def _borders(e: np.ndarray, b: np.ndarray, live: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages over the borders of rows of one chain: into each row from the rows before, and from those after.

    Rows are multiplied up to transfer matrices, all at once; then the chains are walked row by row.
    """
    m, t = live.shape
    into, out = np.ones((m, 2)), np.ones((m, 2))
    followed = np.concatenate([goes_on[1:], np.zeros(1, bool)])
    at = np.flatnonzero(goes_on | followed)
    moves = np.broadcast_to(np.eye(2), (len(at), 2, 2))
    for k in range(t):
        x = moves @ b if k else np.where(goes_on[at, None, None], b, moves)
        x = x * e[at, k][:, None, :]
        moves = np.where(live[at, k][:, None, None], x / x.sum(axis=(1, 2))[:, None, None], moves)
    place = np.zeros(m, dtype=np.int64)
    place[at] = np.arange(len(at))
    starts = np.flatnonzero(~goes_on)
    depth = np.arange(m) - np.repeat(starts, np.diff(np.append(starts, m)))
    later = np.flatnonzero(goes_on)
    later = later[np.argsort(depth[later], kind="stable")]
    steps = np.split(later, np.flatnonzero(np.diff(depth[later])) + 1) if len(later) else []
    for r in steps:
        x = (into[r - 1][:, None, :] @ moves[place[r - 1]])[:, 0]
        into[r] = x / x.sum(axis=1)[:, None]
    for r in reversed(steps):
        x = (moves[place[r]] @ out[r][:, :, None])[:, :, 0]
        out[r - 1] = x / x.sum(axis=1)[:, None]
    return into, out


def marginals(unary: np.ndarray, live: np.ndarray, between: np.ndarray, goes_on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over rows: P(state 1) per token, expected transitions (2, 2), log partition per row.

    ``unary`` is the score of state 1 against state 0; messages are kept normalised.  Rows that
    ``goes_on`` marks continue the chain of the row before, which is full; their log partitions add up.
    """
    m, t = unary.shape
    u = np.stack([np.zeros_like(unary), unary], axis=2)
    top = np.maximum(unary, 0)
    e = np.exp(u - top[:, :, None])
    e[~live] = 1.0
    b = np.exp(between)
    goes_on = np.zeros(m, bool) if goes_on is None else goes_on
    into, out = _borders(e, b, live, goes_on)
    ahead, back, scale = np.empty((t, m, 2)), np.empty((t, m, 2)), np.empty((t, m))
    for k in range(t):
        a = np.where(goes_on[:, None], into @ b, 1.0) * e[:, 0] if k == 0 else np.where(live[:, k, None], (ahead[k - 1] @ b) * e[:, k], ahead[k - 1])
        scale[k] = a.sum(axis=1)
        ahead[k] = a / scale[k][:, None]
    back[t - 1] = out
    for k in range(t - 2, -1, -1):
        x = np.where(live[:, k + 1, None], (back[k + 1] * e[:, k + 1]) @ b.T, back[k + 1])
        back[k] = x / x.sum(axis=1)[:, None]
    joint = ahead * back
    p = np.where(live, (joint[:, :, 1] / joint.sum(axis=2)).T, 0.0)
    pairs = np.zeros((2, 2))
    for k in range(t):
        on = live[:, k] if k else goes_on
        if on.any():
            x = (ahead[k - 1] if k else into)[on][:, :, None] * b * (back[k][on] * e[on, k])[:, None, :]
            pairs += (x / x.sum(axis=(1, 2))[:, None, None]).sum(axis=0)
    first = live.sum(axis=1) > 0
    return p, pairs, np.where(first, np.log(scale).sum(axis=0) + (top * live).sum(axis=1), 0.0)


def _objective(batches: Iterator[pd.DataFrame], unary: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Log-likelihood and observed-minus-expected counts per code and per transition."""
    c = len(unary)
    total = np.zeros(1 + c + 4)
    for b in batches:
        if not len(b):
            continue
        codes, owner = segments([np.asarray(x) for x in b["codes"]])
        tags, _ = segments([np.asarray(x) for x in b["tags"]])
        live, tags = codes >= 0, np.maximum(tags, 0)
        scores = np.where(live, unary[np.maximum(codes, 0)], 0.0)
        goes_on = continued(owner)
        p, pairs, logz = marginals(scores, live, between, goes_on)
        step, border = live[:, 1:], np.flatnonzero(goes_on)
        seen = np.bincount((2 * tags[:, :-1] + tags[:, 1:])[step], minlength=4).astype(float)
        seen += np.bincount(2 * tags[border - 1, -1] + tags[border, 0], minlength=4)
        total[0] += (scores * tags).sum() + (seen * between.ravel()).sum() - logz.sum()
        total[1 : 1 + c] += np.bincount(codes[live], weights=(tags - p)[live], minlength=c)
        total[1 + c :] += seen - pairs.ravel()
    return total


def document_features(p: np.ndarray, owner: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Sum, peak and density of marginals per document, and a constant."""
    k = len(n_words)
    total, peak, likely = np.bincount(owner, weights=p.sum(axis=1), minlength=k), np.zeros(k), np.bincount(owner, weights=(p > LIKELY).sum(axis=1), minlength=k)
    np.maximum.at(peak, owner, p.max(axis=1) if p.size else np.zeros(0))
    return np.stack([np.log1p(total), np.log1p(likely), peak, np.log1p(100 * total / np.maximum(n_words, 1)), np.ones(k)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - q) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lexicon(rows: DataFrame, n1: int, n0: int) -> dict[str, int]:
    """Grams of toxic documents with their level: document counts summed in Spark, filtered before the driver sees them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for text, label in zip(part["text"], part["label"]):
                    seen[label > 0].update({g for w in set(TOKEN.findall(text.lower())) for g in grams_of(w)})
                k0, k1 = seen
                grams = list(k0.keys() | k1.keys())
                yield pd.DataFrame({"gram": grams, "k1": [k1[g] for g in grams], "k0": [k0[g] for g in grams]})

    counts = rows.select("text", "label").mapInPandas(count, "gram string, k1 bigint, k0 bigint")
    sums = counts.groupBy("gram").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    odds = (n1 + 1) / (n0 + 1)
    strong = sums.where((F.col("k1") >= 3) & (F.col("k1") > 2 * odds * F.col("k0"))).collect()
    if not strong:
        return {}
    k1, k0 = np.array([r["k1"] for r in strong], float), np.array([r["k0"] for r in strong], float)
    level = np.searchsorted(LEVELS, evidence(k1, k0, n1, n0), side="right")
    return {r["gram"]: int(v) for r, v in zip(strong, level) if v}


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Field:
    """Lexicon, field and score curve from a bounded sample."""
    ship_package(docs.sparkSession)
    sample = training_sample(docs, labels, label_col, bound, id_col, text_col)
    first = F.col("half") < LEXICON_SHARE
    n, n1, m, m1 = sample.agg(F.count("label"), F.sum(F.signum("label")), F.count(F.when(first, F.lit(1))), F.sum(F.when(first, F.signum("label")))).first()
    if not n or not n1 or n1 == n:
        return Field(constant=float(n1 / n) if n else 0.0)
    lexicon = _lexicon(sample.where(first), int(m1 or 0), int(m - (m1 or 0))) if m1 and m1 < m else {}
    model = Field(lexicon=lexicon, codes=all_codes())
    traits = trait_rows(model.codes)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes, tags = [], []
            for text, label in zip(b["text"], b["label"]):
                t = [model.traits(w) for w in TOKEN.findall(text)]
                codes.append(np.array([model.codes[x] for x in t], dtype=np.int32))
                tags.append(np.array([int(label > 0 and max(x[:2]) >= SEED) for x in t], dtype=np.int32))
            yield pd.DataFrame({"label": b["label"], "codes": codes, "tags": tags})

    rows = materialise(sample.where(~first).mapInPandas(encode, "label int, codes array<int>, tags array<int>"))

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        unary, between = traits @ w[:-4], w[-4:].reshape(2, 2)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"s": [_objective(batches, unary, between)]})

        parts = rows.select("codes", "tags").mapInPandas(part, "s array<double>").collect()
        s = np.sum([np.array(r["s"]) for r in parts], axis=0) if parts else np.zeros(1 + len(unary) + 4)
        grad = np.concatenate([traits.T @ s[1 : 1 + len(unary)], s[1 + len(unary) :]])
        return s[0] - PENALTY / 2 * w @ w, grad - PENALTY * w

    w = _ascend(value, np.concatenate([np.zeros(traits.shape[1] - 1), [-4.0], np.zeros(4)]))
    model.unary, model.between = traits @ w[:-4], w[-4:].reshape(2, 2)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = model_features(model, [np.asarray(c) for c in b["codes"]])[0]
                yield pd.DataFrame({"label": (b["label"] > 0).astype(float), "x": list(x)})

    fit = rows.select("label", "codes").mapInPandas(features, "label double, x array<double>").collect()
    if fit:
        model.curve = _logistic(np.array([r["x"] for r in fit]), np.array([r["label"] for r in fit]))
    else:
        model.curve = np.array([0.0, 0.0, 0.0, 0.0, np.log(n1 / (n - n1))])
    return model


def _ascend(value, w: np.ndarray, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halving steps; every call of ``value`` is one distributed sum."""
    f, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    calls = 1
    while calls < STEPS:
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(np.linalg.norm(g), 1.0)
        for (s, y), a in zip(past, reversed(alphas)):
            q += s * (a - y @ q / (s @ y))
        step = 1.0
        while calls < STEPS:
            nf, ng = value(w + step * q)
            calls += 1
            if nf > f:
                break
            step /= 4
        else:
            break
        s, y = step * q, g - ng
        done = nf - f < 1e-5 * abs(nf)
        w, f, g = w + s, nf, ng
        if s @ y > 1e-10:
            past = [*past[-memory + 1 :], (s, y)]
        if done:
            break
    return w


def model_features(model: Field, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document features, marginals per segment and owner of each segment."""
    rows, owner = segments(codes)
    live = rows >= 0
    p = marginals(np.where(live, model.unary[np.maximum(rows, 0)], 0.0), live, model.between, continued(owner))[0] if len(rows) else np.zeros((0, SEGMENT))
    return document_features(p, owner, np.array([len(c) for c in codes])), p, owner


class Tagger:
    """Scores and offending spans of texts; words met are remembered up to a bound."""

    def __init__(self, model: Field):
        self.model, self.known = model, {}

    def codes(self, text: str) -> np.ndarray:
        known, words = self.known, TOKEN.findall(text)
        for w in set(words).difference(known):
            known[w] = self.model.codes[self.model.traits(w)]
        out = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
        m = self.model
        if m.constant is not None:
            return np.full(len(texts), m.constant), [[] for _ in texts]
        x, p, owner = model_features(m, [self.codes(t) for t in texts])
        spans: list[list[dict]] = [[] for _ in texts]
        first = np.searchsorted(owner, np.arange(len(texts)))
        for d in np.unique(owner[(p > LIKELY).any(axis=1)]) if len(owner) else []:
            q = p[first[d] : first[d] + (owner == d).sum()].ravel()
            for k, match in enumerate(TOKEN.finditer(texts[d])):
                if q[k] > LIKELY:
                    if k and q[k - 1] > LIKELY:
                        spans[d][-1]["end"] = match.end()
                    else:
                        spans[d].append({"start": match.start(), "end": match.end()})
        return 1 / (1 + np.exp(-np.clip(x @ m.curve, -500, 500))), spans


def tagged(model: Field, text: Column, together: int = 64) -> Column:
    """Struct of ``score`` and ``spans`` (code point offsets of offending runs) of a text."""

    @F.pandas_udf("score double, spans array<struct<start:int,end:int>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for texts in batches:
            scores, spans = [], []
            for at in range(0, len(texts), together):
                s, o = tagger.tag(texts.iloc[at : at + together].tolist())
                scores += s.tolist()
                spans += o
            yield pd.DataFrame({"score": pd.Series(scores, dtype=float), "spans": pd.Series(spans, dtype=object)})

    return tag(F.coalesce(text, F.lit("")))
