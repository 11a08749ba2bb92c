import hashlib
import math
import zlib
from collections import Counter

import pytest

from declcensus.llm import resampling as R
from tests.llm.conftest import prose


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) > 127 or c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in lowered).split(" ")


def features(text):
    own = [w for w in words(text) if w]
    return [" ".join(own[k : k + n]) for n in (1, 2, 3) for k in range(len(own) - n + 1)], len(own)


def expected(rows, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    source, aim = (Counter(bucket(f) for t in texts for f in features(t)[0]) for texts in ([t for _, t in rows], target))
    s_all, t_all = sum(source.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in source}
    out = []
    for i, text in rows:
        own, count = features(text)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(own), weight, score, count >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = len(able) * percent // 100
    ranks = Counter()
    places = {}
    for k, r in enumerate(able[:drawn]):
        places.setdefault(r, []).append(k + 1)
    result = []
    for r in out:
        rank = None
        if ranks[r] < len(places.get(r, [])):
            rank = places[r][ranks[r]]
            ranks[r] += 1
        result.append((*r[:4], rank))
    return sorted(result, key=repr)


def got(df, target, **parameters):
    return sorted((tuple(r) for r in R.resampled(df, target, **parameters).collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(k, prose(k, 40)) for k in range(5)] + [(9, None)], "item_id long, text string")


def test_matches_brute_force(spark, target):
    rows = [(k, prose(k, 5 + k % 60)) for k in range(200)] + [(500, "Été 日本語 x_y-z 1a"), (501, "a" * 300)]
    aim = [r["text"] for r in target.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, target) == expected(rows, aim)
    assert got(df, target, percent=40, least_words=3) == expected(rows, aim, 40, 3)


def test_awkward_rows(awkward, nothing, target):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    aim = [r["text"] for r in target.collect()]
    assert got(awkward, target, percent=50) == expected(rows, aim, 50)
    assert got(awkward, nothing, percent=100) == expected(rows, [], 100)
    assert R.resampled(nothing, target).count() == 0


def test_a_scan_gives_all_runs():
    scan = R.Scanner()
    for text in ("", " ", "a", "A b", "one, two three four", "é-ü 日本 x", "a  b\n\nc", "x" * 9 + " y"):
        count, found = scan(text)
        own, n = features(text)
        assert count == n and sorted(found) == sorted(zlib.crc32(f.encode()) % R.BUCKETS for f in own)


def test_texts_like_the_target_are_drawn(spark):
    other = "zun bex qua fli dro mig sot wep"
    rows = spark.createDataFrame([(k, prose(k, 60) if k % 10 == 0 else prose(k, 60, other), "x") for k in range(300)], "doc_id long, text string, rank string")
    aim = spark.createDataFrame([(prose(1000 + k, 60),) for k in range(20)], "text string")
    found = R.drawn(rows, aim)
    assert found.columns == rows.columns
    assert len(chosen := [r["doc_id"] for r in found.collect()]) == 15 and all(i % 10 == 0 for i in chosen)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_other_lengths(longest):
    count, found = R.Scanner(longest, 1 << 30)("a b c a b")
    runs = [" ".join("abcab"[k : k + n]) for n in range(1, longest + 1) for k in range(5 - n + 1)]
    assert count == 5 and sorted(found) == sorted(zlib.crc32(r.encode()) % (1 << 30) for r in runs)
