"""Spelling variant grouping by asymmetric q-chunks.

Words one edit apart are joined on a piece that the edit leaves whole.  Of a
pair, the longer word (of equal lengths, either) contributes two disjoint
chunks, its halves; the other contributes its grams of the chunks' lengths at
the positions where a kept chunk can lie: a first half where it was, a second
half there or, in a shorter word, one to the left.  Grams elsewhere are more than one
edit away and are not made.  Candidates are verified by edit distance.

A chunk that more than ``HOT`` rows share is made longer by a half of what is left of the
word, both halves in turn, as one edit spares one of them too; so no join key
holds more than ``HOT`` rows but those whose open part is a single code point,
which alphabet and word bound.  Nothing is capped.  A pair counts where its first
difference lies in the open part, hence once.

Defined results: a null text has no runs; a null doc_id hashes as an empty
string; repeated rows count each; a table without repeated words gives no rows;
other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

LETTERS = "a-z\\u00C0-\\u00FF"
HOT = 128
FACTOR = 10
EVERY = 31
SAME, LONG, SHORT = 0, 1, 2


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n): letter runs of whole texts, A-Z in lower case; where 31 divides its hash, a run loses one letter."""
    lower = F.translate(F.col(text_col), ascii_uppercase, ascii_lowercase)
    # a match of this many letters cannot start inside a shorter run, so matches are the maximal runs
    runs = F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h, at = F.col("h"), F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))).select(F.when(h % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows whose open part [a, b) of a word of ``size`` code points is given, keyed by what lies on either side of it."""
    rest = F.col("size") - F.col("b")
    word = F.col("word")
    after = word.substr(F.char_length(word) - rest + 1, rest)
    key = F.xxhash64(F.col("role") == SAME, "size", "a", "b", word.substr(F.lit(1), F.col("a")), after)
    return rows.withColumn("key", key)


def _halved(rows: DataFrame) -> DataFrame:
    """Each open part by its two halves."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))
    return _keyed(rows.withColumn("_h", F.explode(halves)).select("word", "n", "role", "size", "_h.a", "_h.b"))


def _chunks_and_grams(words: DataFrame) -> DataFrame:
    """Rows to join: a word as one of equal length, as the longer and as the shorter of a pair."""
    size = F.char_length("word")
    roles = [F.struct(F.lit(role).alias("role"), (size + int(role == SHORT)).alias("size")) for role in (SAME, LONG, SHORT)]
    rows = words.withColumn("_r", F.explode(F.array(*roles))).select("word", "n", "_r.role", "_r.size", F.lit(0).alias("a"), F.col("_r.size").alias("b"))
    return _halved(rows)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, of distinct ``words`` (word, n) exactly one edit apart."""
    rows, settled = materialise(_chunks_and_grams(words)), None
    while True:
        hot = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("b") - F.col("a")).alias("open")).where((F.col("rows") > HOT) & (F.col("open") > 1)).select("key"))
        if hot.isEmpty():
            settled = rows if settled is None else settled.unionByName(rows)
            break
        cold = rows.join(hot, "key", "left_anti").select(*rows.columns)
        settled = cold if settled is None else settled.unionByName(cold)
        rows = materialise(_halved(rows.join(hot, "key", "left_semi")))
    one = settled.where(F.col("role") != SHORT)
    other = settled.where(F.col("role") != LONG).select("key", "size", "a", "b", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("role").alias("near_role"))
    fitting = ((F.col("role") == LONG) & (F.col("near_role") == SHORT)) | ((F.col("role") == SAME) & (F.col("near_role") == SAME) & (F.col("word") < F.col("near")))
    pairs = one.join(other, ["key", "size", "a", "b"]).where(fitting)
    head = lambda c, k: F.col(c).substr(F.lit(1), F.col(k))
    first_difference_here = (head("word", "a") == head("near", "a")) & (head("word", "b") != head("near", "b"))
    pairs = pairs.where(first_difference_here & (F.levenshtein("word", "near", 1) == 1))
    ways = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(ways).alias("_w")).select("_w.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), which holds no circle: the last word that forms lead to.

    Each round doubles the steps taken.
    """
    reached = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        reached = step.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the smallest) if it is at least ``FACTOR`` times as frequent.
    """
    words = materialise(word_counts(docs, id_col, text_col))
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    best = words.join(best, "word", "left").withColumn("form_n", -F.col("top.less"))
    enough = F.col("form_n") >= FACTOR * F.col("n")
    best = materialise(best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("top.near")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")))
    found = roots(best.where("form is not null"))
    return best.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
