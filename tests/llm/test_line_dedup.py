import random

from declcensus.llm import line_dedup as L


def brute(rows, run):
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        lines = text.split("\n")
        for k in range(len(lines) - run + 1):
            held = tuple(lines[k : k + run])
            if held in seen:
                out.setdefault(i, set()).update(range(k, k + run))
            seen.add(held)
    return out


def test_repeats_match_brute_force(spark):
    pick = random.Random(2)
    for run in (1, 2, 3, 4):
        rows = [(k, "\n".join(pick.choice("abcdefgh") for _ in range(pick.randint(0, 30)))) for k in range(40)]
        got = {}
        for r in L.repeats(spark.createDataFrame(rows, "doc_id long, text string"), run=run).collect():
            got.setdefault(r["doc_id"], []).append((r["first_line"], r["last_line"]))
        expected = brute(rows, run)
        assert {k: {x for a, b in v for x in range(a, b + 1)} for k, v in got.items()} == expected
        for spans in got.values():  # the longest runs: none touches the next
            spans.sort()
            assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_every_window_has_a_fingerprint(spark):
    import numpy as np

    for seed in range(30):
        lines = np.random.default_rng(seed).integers(0, 5, 40).astype(np.uint64)
        found = set(L.fingerprints(lines, 4).tolist())
        assert all(found & set(range(k, k + 4)) for k in range(37))


def test_awkward_rows(awkward, nothing, spark):
    rows = [(r["doc_id"], r["text"]) for r in awkward.dropDuplicates(["doc_id", "text"]).collect()]
    got = L.repeats(awkward).collect()
    assert {(r["doc_id"], k) for r in got for k in range(r["first_line"], r["last_line"] + 1)} == {(i, k) for i, v in brute(rows, L.RUN).items() for k in v}
    clean = L.cleaned(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()
    assert {r["text"] for r in clean.collect() if r["doc_id"] == 14} == {"a\n\n\nb"}
    assert {r["text"] for r in clean.collect() if r["doc_id"] == 4} == {None}
    assert L.repeats(nothing).count() == L.cleaned(nothing).count() == 0


def test_long_lines_are_runs_of_their_own(spark):
    pick = random.Random(4)
    lines = [" ".join([f"w{k}"] * (5 + 5 * k)) for k in range(8)]
    rows = [(k, "\n".join(pick.choice(lines) for _ in range(pick.randint(1, 5)))) for k in range(30)]
    expected, seen = brute(rows, 3), set()
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            if len(line.split()) >= 20:
                if line in seen:
                    expected.setdefault(i, set()).add(k)
                seen.add(line)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in L.repeats(docs, long_words=20).collect():
        got.setdefault(r["doc_id"], []).append((r["first_line"], r["last_line"]))
    assert {k: {x for a, b in v for x in range(a, b + 1)} for k, v in got.items()} == expected
    for spans in got.values():
        spans.sort()
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    texts = {r["doc_id"]: r["text"] for r in L.cleaned(docs, long_words=20).collect()}
    kept = [line for t in texts.values() for line in t.split("\n") if len(line.split()) >= 20]
    assert len(kept) == len(set(kept))
