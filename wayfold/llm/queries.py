"""The registered queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import fold_is, table
from wayfold.llm.quality_rules import STOP_WORDS

def vocabulary_path() -> str:
    """Where the public word-level BPE file lies on this machine; only the driver opens it."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return add


STOP_LIST = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
            FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN {STOP_LIST})) AS n_stop,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]'))) AS n_bullet
  FROM d LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words
       AND 50 * n_stop >= n_words AND n_stop >= 2 AND 2 * n_dup_lines <= n_lines AND 10 * n_cut <= 3 * n_lines
       AND 10 * n_bullet <= 9 * n_lines AS kept
FROM b
"""


@query(QUALITY_SQL)
def op8_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.quality_rules import judge
    return judge(table(spark, root, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


LINES_SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
raw AS (SELECT doc_id, coalesce(source, chr(0) || 'none') AS site, unnest(range(1, len(parts) + 1)) AS place,
               unnest(parts) AS line FROM d WHERE text IS NOT NULL),
trimmed AS (SELECT doc_id, site, place, line AS whole,
                   regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line FROM raw),
lines AS (SELECT *, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 3 AS counts FROM trimmed),
spread AS (SELECT line, min(struct_pack(d := doc_id, p := place)) AS first FROM lines WHERE counts GROUP BY line
           HAVING count(DISTINCT site) >= 10),
marked AS (SELECT l.*, s.line IS NOT NULL AND NOT (s.first.d = l.doc_id AND s.first.p = l.place) AS gone
           FROM lines l LEFT JOIN spread s ON l.counts AND l.line = s.line),
cut AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               coalesce(string_agg(whole, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, c.text
FROM d LEFT JOIN cut c USING (doc_id)
"""


@query(LINES_SQL)
def op7_line_spread(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.line_spread import remove_boilerplate
    return remove_boilerplate(table(spark, root, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query()
def op5_bpe_boundaries(spark: SparkSession, root: str, vocabulary: str | None = None) -> DataFrame:
    from wayfold.llm.bpe import digests
    return digests(table(spark, root, "documents"), vocabulary or vocabulary_path())


@query()
def op9_secret_formats(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.secret_formats import find_secrets
    return find_secrets(table(spark, root, "documents"))


@query()
def op6_toxic_segments(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm import toxicity
    docs = table(spark, root, "documents")
    held_out = lambda doc_id: fold_is(doc_id, 4, 2)
    model = toxicity.fit(docs, table(spark, root, "labels"), held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_passages", "passages")


MIX_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source,
                  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
                  CAST('0x' || substr(md5('1:' || doc_id), 1, 15) AS BIGINT) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS place FROM s0),
s2 AS (SELECT *, place % 3 + 1 AS w FROM s1),
s3 AS (SELECT *, coalesce(sum(3 * n) OVER before, 0) AS capped, coalesce(sum(w) OVER before, 0) AS used,
              sum(n) OVER () AS total, sum(w) OVER () AS weight FROM s2
       WINDOW before AS (ORDER BY 3 * n / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - capped) * w > 3 * n * (weight - used) AS stops FROM s3),
s5 AS (SELECT total - coalesce(sum(3 * n) FILTER (stops), 0) AS open_words, weight - coalesce(sum(w) FILTER (stops), 0) AS open_weight
       FROM s4 GROUP BY total, weight),
s6 AS (SELECT source, place, n, CASE WHEN stops THEN CAST(3 * n AS DOUBLE)
                  ELSE CAST(w * open_words AS DOUBLE) / CAST(open_weight AS DOUBLE) END AS target FROM s4, s5),
s7 AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * n) AS words, greatest(1, -(-n // 131072)) AS blocks FROM s6),
e AS (SELECT d.*, place, n, target, k % greatest(1, CAST(ceil(n / 131072.0) AS BIGINT)) AS block,
             CASE WHEN n > 0 THEN words // n ELSE 0 END AS epochs, CASE WHEN n > 0 THEN words % n ELSE 0 END AS rest
      FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
b AS (SELECT place, block, coalesce(sum(sum(size)) OVER (PARTITION BY place ORDER BY md5('1:' || place || ':' || block), block
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e GROUP BY place, block),
f AS (SELECT e.*, before + coalesce(sum(size) OVER (PARTITION BY e.place, e.block ORDER BY k, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM e JOIN b ON e.place = b.place AND e.block = b.block)
SELECT doc_id, size, n AS source_size, target,
       CAST(epochs * size + least(greatest(rest - start, 0), size) AS BIGINT) AS taken FROM f
"""


@query(MIX_SQL)
def op2_source_mix(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.mixing import mix
    return mix(table(spark, root, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"]).alias("taken"))


@query()
def op4_url_rules(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.url_rules import judge
    return judge(table(spark, root, "pages"), table(spark, root, "labels"))


@query()
def op3_adaptive_scan(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.ann import search
    return search(table(spark, root, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op10_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.jaccard_join import near_duplicates
    return near_duplicates(table(spark, root, "documents"))


@query()
def op1_trie_scores(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.ngram_model import score
    return score(table(spark, root, "documents"), fold_is(F.col("doc_id"), 7, 2))


MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
             coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query(MIDDLE_SQL)
def op11_fill_middle(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.fill_middle import restored, transform
    return transform(table(spark, root, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


LEAKS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, t)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""


@query(LEAKS_SQL)
def op12_benchmark_leaks(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.leakage import leaks
    return leaks(table(spark, root, "documents"), table(spark, root, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tokens AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
keep AS (SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
langs AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS HUGEINT) AS lang_total FROM keep GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n, v, lang_total,
                 CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS HUGEINT) AS total
          FROM groups g JOIN keep k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
               LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT *, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (total + v) AS p,
                  1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 1)) // (lang_total + v) AS q FROM dense),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value,
                  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL
           SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query(DIVERGENCE_SQL)
def op13_source_divergence(spark: SparkSession, root: str) -> DataFrame:
    from wayfold.llm.divergence import audit
    return audit(table(spark, root, "documents"))
