import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from declcensus.llm import suffix_tree as S
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["\0"]


def root_scores(rows, train):
    counts = Counter(w for t in train for w in split(t))
    total, room = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    return total, [(i, len(split(t)), sum(counts[w] > 0 for w in split(t)), sum(math.log10((counts[w] + 0.5) / max(room, 1)) for w in split(t))) for i, t in rows]


def test_words_are_those_of_plain_splitting():
    texts = ["The END of\x0bIt ÀÉ", "", "  ", "a", "A b\x1cc", "x" * 5000]
    words = S.Words([S.lowered(t) for t in texts])
    got = [(int(o), words.word(k).decode()) for k, o in enumerate(words.owner)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in split(t)[:-1]]
    flat = [w.encode() for t in texts for w in split(t)[:-1]]
    assert (S.word_keys(flat) == words.keys).all() and len(set(words.keys.tolist())) == len(set(flat))


def test_root_scores_match_plain_counting(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for train in (awkward, awkward.filter("doc_id > 9"), nothing):
        tree, words = S.fit(train)
        total, expected = root_scores(rows, [r["text"] for r in train.collect()])
        got = S.score(awkward, tree, words, carried=("doc_id",)).collect()
        assert tree.total == total
        key = lambda r: repr(r[:3])
        for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])
    assert S.score(nothing, *S.fit(awkward)).count() == 0


@pytest.fixture(scope="module")
def chained(spark):
    """Words that follow from the two before."""
    vocabulary = [f"w{k}" for k in range(12)]
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        words = ["w0", "w1"]
        for _ in range(60):
            a, b = int(words[-2][1:]), int(words[-1][1:])
            words.append(vocabulary[(3 * a + 5 * b) % 12] if rng.random() < 0.8 else vocabulary[rng.integers(12)])
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


class Plain:
    """The same model with dictionaries: states, divergence test, discounting, longest state."""

    def __init__(self, texts, order=3, least=5):
        rows = [["\0", *split(t)] for t in texts]
        levels = [Counter(w for r in rows for w in r[1:])]
        for k in range(2, order + 2):
            levels.append(Counter(tuple(r[i : i + k]) for r in rows for i in range(len(r) - k + 1)))
        self.words, self.total = levels[0], sum(levels[0].values())
        self.room = self.total + 0.5 * (len(levels[0]) + 1)
        counts = {(w,): n for w, n in levels[0].items() if n >= least}
        p = {s: (n + 0.5) / self.room for s, n in counts.items()}
        self.listed, self.left = [], []
        for level in levels[1:]:
            found = {s: n for s, n in level.items() if n >= least}
            listed, left, after = {}, {}, {}
            groups = {}
            for s in found:
                groups.setdefault(s[:-1], []).append(s)
            for context, own in groups.items():
                of = counts[context]
                rest, unlikely = max(of - sum(found[s] for s in own), 0), max(1 - sum(p[s[1:]] for s in own), 1e-12)
                gain = sum(found[s] * math.log(found[s] / of / p[s[1:]]) for s in own)
                gain += rest * math.log(rest / of / unlikely) if rest else 0
                stays = gain > 0.5 * math.log(max(of, 2)) * len(own)
                if stays:
                    left[context] = math.log10((rest + S.DISCOUNT * len(own)) / of / unlikely)
                for s in own:
                    after[s] = (found[s] - S.DISCOUNT) / of if stays else p[s[1:]]
                    if stays:
                        listed[s] = math.log10(after[s])
            self.listed.append(listed)
            self.left.append(left)
            counts, p = found, after

    def step(self, before, word):
        """log10 of the probability of a word after others, the first of which is the start."""
        value = math.log10((self.words[word] + 0.5) / self.room)
        for k, (listed, left) in enumerate(zip(self.listed, self.left), 1):
            if len(before) >= k:
                value += left.get(tuple(before[-k:]), 0)
                value = listed.get((*before[-k:], word), value)
        return value

    def score(self, text):
        row = ["\0", *split(text)]
        return sum(self.step(row[:i], row[i]) for i in range(1, len(row)))


def scores(tree, words, df):
    return {r["doc_id"]: r["score"] for r in S.score(df, tree, words, carried=("doc_id",)).collect()}


def close(got, model, rows):
    assert got.keys() == {i for i, _ in rows}
    for i, text in rows:
        assert got[i] == pytest.approx(model.score(text), abs=1e-8), (i, text)


# Shares of 1 let no sequence be looked up in the tasks, of 0 all: the results are the same.
@pytest.mark.parametrize("share", [S.SHARE, 0.003, 1.0])
def test_scores_match_a_plain_tree(spark, chained, share):
    rows = [(r["doc_id"], r["text"]) for r in chained.collect()]
    train = [t for i, t in rows if i % 2 == 0]
    rows += [(1000, ""), (1001, None), (1002, "w0 nothing w1"), (1003, "w3"), (1004, "W0 w1  w8\nw9")]
    model = Plain(train)
    assert all(model.left) and len(model.left[1]) > len(model.left[0])
    tree, words = S.fit(chained.filter("doc_id % 2 = 0"), share=share, word_share=share)
    close(scores(tree, words, spark.createDataFrame(rows, "doc_id long, text string")), model, rows)


def test_a_small_filter_changes_nothing(spark, chained):
    """A filter that lets everything through only makes more rows to join."""
    rows = [(r["doc_id"], r["text"]) for r in chained.limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tree, words = S.fit(df, share=1.0, filter_bits=6)
    close(scores(tree, words, df), Plain([t for _, t in rows]), rows)


def test_the_tree_grows_with_the_corpus(spark, chained):
    sizes = [S.fit(chained.filter(f"doc_id < {n}"), share=1.0)[0].values.count() for n in (50, 100, 200, 400)]
    assert sizes == sorted(sizes) and sizes[-1] > 1.5 * sizes[0]


def test_contexts_help_on_held_out_texts(chained):
    tree, words = S.fit(chained.filter("doc_id % 2 = 0"))
    got = S.score(chained.filter("doc_id % 2 = 1"), tree, words)
    row = got.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert row["score"] > 0.6 * row["base"]  # both are negative


def test_distributions_sum_to_one(chained):
    """Of the plain tree, which scores as the other does."""
    model = Plain([r["text"] for r in chained.collect()])
    for context in ("", "w0 w1", "w3 w4 w5", "w0"):
        before = ["\0", *split(context)[:-1]]
        assert sum(10 ** model.step(before, w) for w in [*model.words, "unknownword"]) == pytest.approx(1, abs=0.02)


def test_random_prose_is_not_made_worse(spark):
    rows = spark.createDataFrame([(k, prose(k, 80)) for k in range(300)], "doc_id long, text string")
    tree, words = S.fit(rows.filter("doc_id % 3 > 0"))
    row = S.score(rows.filter("doc_id % 3 = 0"), tree, words).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > 1.02 * row["b"]


def test_sequences_to_join_are_dealt_to_rounds_by_key():
    texts = ["a b a b a c", "", None, "a b", "x " * 50]
    _, keys, counts, _ = S._stream(texts)
    levels = list(S._levels(keys, counts, 4))
    others = S.Filter(6)
    others.words[:] = np.uint64(2**64 - 1)
    none = S.Table(np.zeros(0, np.uint64), np.zeros(0))
    tree = S.SuffixTree(10, 5, none, none, others, None)
    batch = S.pa.RecordBatch.from_arrays([S.pa.array(range(len(texts))), S.pa.array(texts)], names=["row", "text"])
    rows = [r for found in S._scored(iter([batch]), tree, 3) for r in found.to_pylist()]
    ends = np.cumsum(counts)
    for row, start, end in zip(rows, ends - counts, ends, strict=True):
        expected = Counter(int(k) for n, level in enumerate(levels) for k in level[start : end - (n == 0)].view(np.int64) if k)
        got = {}
        for r in range(S._ROUNDS):
            assert all(k & (S._ROUNDS - 1) == r for k in row[f"keys{r}"])
            got |= dict(zip(row[f"keys{r}"], row[f"times{r}"], strict=True))
        assert got == expected
    assert all(any(row[f"keys{r}"] for row in rows) for r in range(S._ROUNDS))


def test_values_are_found_in_any_order():
    rng = np.random.default_rng(4)
    known = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    table = S.Table(known[::-1], np.arange(len(known))[::-1])
    keys = rng.permutation(np.concatenate((known, known[:50], rng.integers(0, 1 << 63, 300).astype(np.uint64))))
    at, place = table.find(keys)
    assert sorted(at.tolist()) == np.flatnonzero(np.isin(keys, known)).tolist() and (known[place] == keys[at]).all()
    assert (table.values[0][place] == place).all()


def test_a_pass_over_the_texts_counts_a_length_and_finds_the_parts_of_the_one_before(spark, chained):
    read = spark.sparkContext.accumulator(0)

    def seen(it):
        for batch in it:
            read.add(batch.num_rows)
            yield batch

    tree, _ = S.fit(chained.select("text").mapInArrow(seen, "text string"))
    assert len(tree.often.keys) and 0 < read.value <= (S.ORDER + 2) * chained.count()


def test_counts_are_dealt_as_a_row_per_part():
    texts = ["a b a b a c", "", None, "A b", "x y z " * 500, *(f"u{k} v{k}" for k in range(3000))]
    batch = S.pa.RecordBatch.from_arrays([S.pa.array(texts)], names=["text"])
    known = S.Filter(6)
    known.words[:] = np.uint64(2**64 - 1)
    _, keys, counts, _ = S._stream(texts)
    levels = list(S._levels(keys, counts, 4))
    for length in range(5):
        rows = [r for found in S._counted(iter([batch]), known, length, 3, 4) for r in found.to_pylist()]
        assert len(rows) <= 2 * 16
        own = S.pa.Table.from_pylist(rows)
        got = {}
        for parts, kind in ((True, np.uint64), (False, np.int32)):
            some = own.filter(S.pc.equal(own.column("parts"), parts))
            found = S.unpacked(some.column("key"), np.uint64)
            got[parts] = dict(zip(found.tolist(), S.unpacked(some.column("other"), kind).tolist(), strict=True))
            assert (found >> np.uint64(60) == np.repeat(some.column("part").to_numpy(), [len(k) // 8 for k in some.column("key").to_pylist()])).all()
        if length < 4:
            level = levels[length].copy()
            if length == 0:
                level[np.cumsum(counts) - counts] = 0  # the start is no token
            assert got[False] == Counter(level[level != 0].tolist())
        else:
            assert got[False] == {}
        level = levels[length - 1]
        at = np.flatnonzero(level) if length > 1 else []
        assert got[True] == {int(level[k]): int(levels[length - 2][k - 1]) for k in at}
        for k in at:
            assert S.after_of(level[k : k + 1], levels[length - 2][k - 1 : k]) == levels[length - 2][k]
