"""Registered queries of the corpus operators, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declcensus.llm import (
    decontamination,
    exact_dedup,
    fixity,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    ngram_join,
    paragraph_dedup,
    resampling,
    suffix_tree,
    url_filter,
    vector_codes,
)
from declcensus.operators.ordering import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op1_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = language_id.train(documents.filter(_fold(3) != 1))
    found = language_id.identify(documents, model, carried=("doc_id",))
    held_out = F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op2_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeats(_table(spark, sf_dir, "documents"))


# What the mix of the registered query and of the pipeline aims at.
TOPICS = {"legal": "icense", "contact": "@", "table": " | "}
TARGETS: dict[str, dict[str, float] | None] = {
    "source": None,
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
    "topic": {"prose": 0.7, "table": 0.1, "legal": 0.1, "contact": 0.1},
}


def mixed(documents: DataFrame, fraction: float | None = mixing.FRACTION, bounded: bool = True) -> DataFrame:
    dimensions = {
        "source": F.col("source"),
        "lang": F.col("lang"),
        "topic": mixing.topic(F.col("text"), TOPICS, "prose"),
    }
    return mixing.sample(documents, dimensions, TARGETS, fraction=fraction, bounded=bounded)


def op3_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As large as all weights allow.
    return mixed(_table(spark, sf_dir, "documents"), fraction=None, bounded=False).select(
        "row.doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled"
    )


def _mix_oracle() -> str:
    topic = " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in TOPICS.items())
    steps, last = [], "start"
    for name, weights in TARGETS.items():
        listed = " ".join(f"WHEN '{k}' THEN {v}" for k, v in (weights or {}).items())
        weight = f"CASE {name} {listed} ELSE {mixing.OTHER} END" if weights else "1.0"
        steps.append(
            f"want_{name} AS (SELECT {name}, w / sum(w) OVER () AS want FROM "
            f"(SELECT {name}, CAST({weight} AS DOUBLE) AS w FROM cells GROUP BY {name}))"
        )
    for k in range(mixing.SWEEPS):
        for name in TARGETS:
            step = f"s{k}_{name}"
            steps.append(
                f"{step} AS (SELECT {', '.join(TARGETS)}, tokens, "
                f"share * want / sum(share) OVER (PARTITION BY {name}) AS share "
                f"FROM {last} JOIN want_{name} USING ({name}))"
            )
            last = step
    keys = ", ".join(TARGETS)
    return f"""
        WITH docs AS (
            SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
                   CASE {topic} ELSE 'prose' END AS topic,
                   len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS tokens
            FROM documents),
        cells AS (SELECT {keys}, sum(tokens) AS tokens FROM docs GROUP BY ALL),
        start AS (SELECT *, CAST(tokens AS DOUBLE) AS share FROM cells),
        {", ".join(steps)},
        size AS (SELECT least({mixing.FRACTION} * sum(tokens), min(CASE WHEN share > 0 THEN tokens / share END)) AS size FROM {last}),
        rates AS (
            SELECT {keys}, CASE WHEN tokens > 0
                THEN least(share * (SELECT size FROM size) / tokens, 1.0) ELSE 0.0 END AS p
            FROM {last})
        SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, round(p, 6) AS probability,
               CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 < p AS sampled
        FROM docs JOIN rates USING ({keys})
    """


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


# Stands for what a second archive holds: of some pages a byte is changed, the body is blank,
# or nothing can be read.
CHANGED, BLANK, LOST = 0, 1, 2
_DAMAGE = 53


def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    kind = F.pmod("page_id", F.lit(_DAMAGE))

    def replica(record: Column) -> Column:
        changed = F.overlay(record, F.lit(b"w"), F.lit(1))
        return (
            F.when(kind == CHANGED, changed).when(kind == BLANK, F.repeat(F.lit(" "), F.octet_length(record)).cast("binary"))
            .when(kind == LOST, F.lit(None)).otherwise(record)
        )

    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    return fixity.audit(pages, record, replica, "page_id", F.col("key"))


_AUDIT_ORACLE = f"""
    WITH records AS (
        SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS place,
               octet_length(encode(concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10),
                   'WARC-Record-ID: <urn:record:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
                   'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', octet_length(encode(coalesce(html, ''))),
                   chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)))) AS length
        FROM pages),
    placed AS (
        SELECT *, place // {fixity.FILE_RECORDS} AS file,
               coalesce(sum(length) OVER (PARTITION BY place // {fixity.FILE_RECORDS} ORDER BY place
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM records)
    SELECT page_id, CAST(file AS BIGINT) AS file, CAST(start AS BIGINT) AS "start_offset", CAST(length AS BIGINT) AS length,
           CASE WHEN page_id % {_DAMAGE} = {LOST} THEN 'missing' ELSE 'changed' END AS finding
    FROM placed WHERE page_id % {_DAMAGE} IN ({CHANGED}, {BLANK}, {LOST})
"""

# The rules that the registered query is to apply, as (verdict, host, path).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op6_boosted_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_table(spark, sf_dir, "documents"), keep="largest")


def op9_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeats(_table(spark, sf_dir, "documents"), long_words=line_dedup.LONG_WORDS)


_LINES_ORACLE = f"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    runs AS (
        SELECT doc_id, pos, list(line) OVER w AS held, count(*) OVER w AS n FROM lines
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {line_dedup.RUN - 1} FOLLOWING)),
    long AS (SELECT * FROM lines WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {line_dedup.LONG_WORDS}),
    later AS (
        SELECT doc_id, pos, pos + {line_dedup.RUN - 1} AS stop FROM runs WHERE n = {line_dedup.RUN}
        QUALIFY row_number() OVER (PARTITION BY held ORDER BY doc_id, pos) > 1
        UNION
        SELECT doc_id, pos, pos AS stop FROM long QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1),
    marked AS (
        SELECT doc_id, pos, stop, CASE WHEN pos <= max(stop) OVER (
            PARTITION BY doc_id ORDER BY pos, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh
        FROM later),
    islands AS (
        SELECT doc_id, pos, stop, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos, stop ROWS UNBOUNDED PRECEDING) AS island FROM marked)
    SELECT doc_id, min(pos) AS first_line, max(stop) AS last_line
    FROM islands GROUP BY doc_id, island
"""


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    tree, words = suffix_tree.fit(documents.filter(_fold(5) != 1))
    found = suffix_tree.score(documents, tree, words, carried=("doc_id",))
    return found.select(
        "doc_id", F.coalesce(_fold(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op11_ngram_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(_table(spark, sf_dir, "documents"))


def op12_overlapped_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(_table(spark, sf_dir, "embeddings"), carried=("label",))
    rows = materialize(codes.table)
    labels = materialize(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return rows.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", vector_codes.hexadecimal(F.col("codes")).alias("code"), "error", "label_error",
        F.lit(codes.sha256()).alias("codebooks_sha256"),
    )


_JOIN_ORACLE = f"""
    WITH RECURSIVE split AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    grams AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {ngram_join.WORDS} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {ngram_join.WORDS - 2}), lambda i: array_to_string(w[i:i + {ngram_join.WORDS - 1}], ' ')) END) AS g
        FROM split),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (
        SELECT o.a, o.b FROM common o JOIN sizes x ON x.doc_id = o.a JOIN sizes y ON y.doc_id = o.b
        WHERE 100 * o.n >= {ngram_join.PERCENT} * (x.n + y.n - o.n)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
    FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def _resampling_oracle() -> str:
    def runs(rows: str) -> str:
        """One row per feature; ``key`` is the text that it is in."""
        ahead = [f"lead(x, {k}) OVER (PARTITION BY key ORDER BY i)" for k in range(1, resampling.LONGEST)]
        listed = ", ".join(" || ' ' || ".join(["x", *ahead[:k]]) for k in range(resampling.LONGEST))
        tokens = f"SELECT key, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM ({rows})"
        return f"SELECT key, f FROM (SELECT key, unnest([{listed}]) AS f FROM ({tokens})) WHERE f IS NOT NULL"

    # The remainder of each byte, by the rule of the checksum.
    table = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), byte) for byte in range(256)]
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
    )
    return f"""
        WITH docs AS (SELECT doc_id, {words} FROM documents),
        source AS ({runs("SELECT doc_id AS key, w FROM docs")}),
        target AS ({runs(f"SELECT item_id AS key, {words} FROM benchmark")}),
        hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM source UNION SELECT f FROM target)),
        bytes AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)) AS b FROM hexed),
        buckets AS (
            SELECT f, xor(list_reduce([4294967295] || b, lambda x, y: xor(x >> 8, {table}[CAST((xor(x, y) & 255) + 1 AS BIGINT)])), 4294967295) % {resampling.BUCKETS} AS bucket
            FROM bytes),
        s AS (SELECT bucket, count(*) AS n FROM source JOIN buckets USING (f) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM target JOIN buckets USING (f) GROUP BY bucket),
        totals AS (SELECT (SELECT count(*) FROM source) AS s_all, (SELECT count(*) FROM target) AS t_all),
        gains AS (
            SELECT s.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (s_all + {resampling.BUCKETS}) AS DOUBLE)
                   / CAST((s.n + 1) * (t_all + {resampling.BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket), totals),
        weights AS (
            SELECT key AS doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
            FROM source JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY key),
        scored AS (
            SELECT d.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{resampling.SEED}:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE)
                        / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM docs d LEFT JOIN weights USING (doc_id)),
        able AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
            FROM scored WHERE words >= {resampling.LEAST_WORDS})
        SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= {resampling.PERCENT} * n // 100 THEN place END AS rank
        FROM scored s LEFT JOIN able USING (doc_id)
    """


def _codes_oracle() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = []
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
            near{k} AS (
                SELECT vec_id, p, min(d * {entries} + e) % {entries} AS e, min(d * {entries} + e) // {entries} AS d FROM (
                    SELECT x.vec_id, x.p, b.e, CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS BIGINT) AS d
                    FROM cut x JOIN book{k} b USING (p)) GROUP BY vec_id, p)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""
            means{k} AS (
                SELECT p, e, list(m ORDER BY i) AS v FROM (
                    SELECT p, e, i, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (
                        SELECT n.p, n.e, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS i FROM near{k} n JOIN cut x USING (vec_id, p))
                    GROUP BY p, e, i) GROUP BY p, e),
            book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m USING (p, e))""")
    last = vector_codes.ROUNDS
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS (SELECT vec_id, p, v[CAST(p * (len(v) // {parts}) + 1 AS BIGINT):CAST((p + 1) * (len(v) // {parts}) AS BIGINT)] AS v FROM kept, range({parts}) r(p)),
        book0 AS (SELECT p, e, v FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < {entries}),
        {", ".join(steps)},
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY vec_id),
        digest AS (
            SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
            FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM book{last}))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id), digest
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_bitmasks": op1_language_bitmasks,
    "op2_paragraph_bands": op2_paragraph_bands,
    "op3_raked_mix": op3_raked_mix,
    "op4_order_minhash": op4_order_minhash,
    "op5_merkle_audit": op5_merkle_audit,
    "op6_boosted_url_trees": op6_boosted_url_trees,
    "op7_pigeonhole": op7_pigeonhole,
    "op8_content_sort": op8_content_sort,
    "op9_line_winnowing": op9_line_winnowing,
    "op10_suffix_tree": op10_suffix_tree,
    "op11_ngram_product": op11_ngram_product,
    "op12_overlapped_resampling": op12_overlapped_resampling,
    "op13_cover_tree_codes": op13_cover_tree_codes,
}

ORACLES: dict[str, str] = {
    "op9_line_winnowing": _LINES_ORACLE,
    "op11_ngram_product": _JOIN_ORACLE,
    "op12_overlapped_resampling": _resampling_oracle(),
    "op13_cover_tree_codes": _codes_oracle(),
    "op3_raked_mix": _mix_oracle(),
    "op5_merkle_audit": _AUDIT_ORACLE,
    "op8_content_sort": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
