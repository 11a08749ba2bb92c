import hashlib

from pyspark.sql import functions as F

from declcensus.llm import fixity


def _expected(rows, damage):
    offset, out = {}, []
    for place, (key, body) in enumerate(rows):
        file = place // fixity.FILE_RECORDS
        content, other = body, damage(key, body)
        if other != content:
            out.append((key, file, offset.get(file, 0), len(content), "missing" if other is None else "changed"))
        offset[file] = offset.get(file, 0) + len(content)
    return sorted(out, key=repr)


def _audit(df, replica):
    got = fixity.audit(df, F.coalesce(F.col("text"), F.lit("")).cast("binary"), replica, "doc_id", F.col("key"))
    return sorted(map(tuple, got.collect()), key=repr)


def test_damage_is_found_at_its_place(spark, monkeypatch):
    monkeypatch.setattr(fixity, "FILE_RECORDS", 256)
    rows = [(k, f"record {k} " * (k % 5)) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lost, other = F.col("doc_id") == 300, F.col("doc_id").isin(1, 256, 511, 699)
    got = _audit(df, lambda c: F.when(lost, None).when(other, F.concat(c, F.lit(b"!"))).otherwise(c))

    def damage(k, body):
        return None if k == 300 else body + b"!" if k in (1, 256, 511, 699) else body

    assert got == _expected([(k, t.encode()) for k, t in rows], damage)
    assert _audit(df, lambda c: c) == []


def test_only_differing_branches_are_read(spark):
    leaves = spark.range(600).select(
        F.col("id").alias("node"), F.col("id").alias("start"), (F.col("id") + 1).alias("stop"), F.sha2(F.col("id").cast("string"), 256).alias("digest")
    )
    one = fixity.tree(leaves, fixity.depth(600))
    other = fixity.tree(leaves.filter("node <> 37").withColumn("digest", F.when(F.col("node") == 411, "x").otherwise(F.col("digest"))), fixity.depth(600))
    assert [t.count() for t in one] == [600, 38, 3, 1]
    differ = [a.join(b, ["node", "digest"], "left_anti").count() for a, b in zip(one, other, strict=True)]
    assert differ == [2, 2, 2, 1]
    assert sorted(map(tuple, fixity.differing(one, other).collect())) == [(37, "missing"), (411, "changed")]
    assert sorted(map(tuple, fixity.differing(other, one).collect())) == [(37, "extra"), (411, "changed")]


def test_record_bytes(spark):
    row = spark.createDataFrame([(5, "http://a/", "ü")], "k long, u string, b string").select(fixity.warc_record(F.col("k"), F.col("u"), F.col("b"))).first()[0]
    head, body = bytes(row).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\n") and b"Content-Length: 2" in head and body == "ü".encode() + b"\r\n\r\n"
    assert len(hashlib.sha256(row).hexdigest()) == 64


def test_awkward_rows(awkward, nothing):
    assert _audit(awkward, lambda c: c) == []
    got = _audit(awkward, lambda c: F.lit(None).cast("binary"))
    assert len(got) == awkward.count() and {r[4] for r in got} == {"missing"}
    assert _audit(nothing, lambda c: c) == []
