"""Registered queries of the corpus operators and the SQL of those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm import (classlm, codes, exact, imatch, mixing, near, packing, quality, resample, secrets, subwords, templates,
                           toxicity)
from tapeworks.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op1_imatch_lexicons")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op2_toxicity_cnn")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_quality_gam")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_tree_merge_dedup", """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
                  AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).drop("raw")


@query("op5_secret_battery")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op6_vector_best_fit")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_tokenizer())


@query("op7_class_lm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.corpus_scores(table(spark, sf_dir, "documents"))


@query("op8_fair_queue_mix", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most,
             1.5::DOUBLE * sum(source_size) OVER () AS total FROM r),
l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, place, total,
             least(most, weight * coalesce(max(CASE WHEN level * weight <= most THEN level END) OVER (), max(level) OVER ())) AS target FROM l),
u AS (SELECT d.source, h, doc_id, size, sum(size) AS words FROM d WHERE size > 0 GROUP BY ALL),
q AS (SELECT u.*, t.place, t.source_size, t.target, t.total,
             sum(words) OVER (PARTITION BY u.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
i AS (SELECT q.*, round, (upto + round * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(round)),
k AS (SELECT *, sum(words) OVER (ORDER BY finish, place ROWS UNBOUNDED PRECEDING) AS spent FROM i),
c AS (SELECT source, doc_id, size, count(*) AS copies FROM k WHERE spent <= total GROUP BY ALL)
SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, t.target, (coalesce(c.copies, 0) * d.size)::BIGINT AS taken,
       coalesce(c.copies, 0)::BIGINT AS copies
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.size = d.size""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op9_coordinate_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("raw")


@query("op10_line_templates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.line_report(table(spark, sf_dir, "documents"))


_ROUND = """
{a} AS (SELECT part, vec_id, label, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
        FROM (SELECT p.*, c.entry, list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
              FROM p JOIN {c} c USING (part)) GROUP BY ALL)"""
_MEANS = """
{n} AS (SELECT c.part, c.entry, coalesce(m.y, c.y) AS y FROM {c} c LEFT JOIN (
          SELECT part, entry, list(v ORDER BY place) AS y FROM (
            SELECT part, entry, place, floor(sum(x[place])::DOUBLE / count(*))::BIGINT AS v
            FROM {a}, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM p))) AS place) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))"""


@query("op11_dual_tree_codes", """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, x[part * (len(x) // 16) + 1:(part + 1) * (len(x) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, entry, x AS y FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v
       ORDER BY vec_id LIMIT 64) USING (vec_id)),""" + _ROUND.format(a="a1", c="c0") + "," + _MEANS.format(n="c1", c="c0", a="a1") + ","
       + _ROUND.format(a="a2", c="c1") + "," + _MEANS.format(n="c2", c="c1", a="a2") + "," + _ROUND.format(a="a3", c="c2") + """,
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
e AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
      FROM a3 GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256, label FROM e, h""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


@query("op12_distinct_words")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.digests(table(spark, sf_dir, "documents"), subwords.default_model())


@query("op13_median_draw", r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (SELECT 0 AS kind, row_number() OVER () AS row, doc_id AS id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
      UNION ALL
      SELECT 1, row_number() OVER (), item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT kind, row, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
                               || list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS feature
      FROM w),
n AS (SELECT kind, row, feature, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT feature, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: ('0x' || x)::BIGINT),
                          lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT feature FROM n), tab),
c AS (SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM n JOIN b USING (feature) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM c)::DOUBLE
                                     / ((coalesce(s, 0) + 1)::DOUBLE * (SELECT sum(t) + 10000 FROM c)::DOUBLE)))::BIGINT AS gain FROM c),
d AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN b USING (feature) JOIN g USING (bucket)
      WHERE kind = 0 GROUP BY row),
e AS (SELECT id AS doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM w LEFT JOIN d USING (row) WHERE kind = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
             5 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS most FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM r""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
