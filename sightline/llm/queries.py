"""The queries op1 to op13 and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import ensure_checkpoint_dir
from . import bpe, decontam, langid, licenses, lines, pii, quality, repair, rollup, simhash, substring, toxicity, trie
from .text import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def ranks_path() -> str:
    """Where the ranks of the public 50k byte-level vocabulary are."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op1_substring_dedup", r"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n
           FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
win AS (SELECT doc_id, pos, n, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS seq FROM w),
firsts AS (SELECT seq, min(doc_id) AS first FROM win WHERE pos + 13 <= n GROUP BY seq HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, win.pos, win.word, (win.pos + 13 <= win.n AND firsts.first < win.doc_id) IS TRUE AS hit FROM win LEFT JOIN firsts USING (seq)),
gone AS (SELECT doc_id, pos, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hit),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_pii_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(read(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 5)
    model = langid.fit_all(docs, part > 1, part == 1)
    out = langid.score(docs, model, ["doc_id"])
    return out.select("doc_id", (part == 0).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query("op4_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs AS (SELECT doc_id, i, k, line, lead(line) OVER o AS line2, lead(i) OVER o AS i2 FROM filled WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
runs AS (SELECT doc_id, i, i AS last, line AS a, NULL AS b, 1 AS n FROM pairs WHERE strlen(line) >= 160 OR len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 5
         UNION ALL SELECT doc_id, i, i2, line, line2, 2 FROM pairs WHERE line2 IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b, n ORDER BY doc_id, i) AS r FROM runs),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM ranked WHERE r > 1 UNION ALL SELECT doc_id, last FROM ranked WHERE r > 1)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS kept
         FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_token_rollup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents; then delete later exact copies and revise texts with symbols, which are cut out. The second batch is committed twice."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/rollup-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    held = rollup.Rollup(spark, folder, {"byte-bpe-50k": ranks_path(), "words-1": rollup.words()})
    held.commit(1, docs.withColumn("op", F.lit("insert")))
    first, last = later_changes(docs)
    for _ in range(2):
        held.commit(2, first.unionByName(last))
    return held.totals()


def later_changes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes of later exact copies, revisions of the other texts with symbols."""
    text = F.struct(F.xxhash64("text").alias("a"), F.md5("text").alias("b"))
    of_text = docs.filter("text is not null").select("doc_id", text.alias("t"))
    lowest = of_text.groupBy("t").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", "low")
    copies = of_text.join(lowest, "t").filter("doc_id > low").select("doc_id")
    none = F.lit(None).cast("string")
    deletes = copies.select("doc_id", none.alias("text"), none.alias("source"), none.alias("lang"), F.lit("delete").alias("op"))
    symbols = r"[#*$%&|<>]+"
    revised = docs.filter(F.col("text").rlike(symbols)).join(copies, "doc_id", "left_anti")
    return deletes, revised.withColumn("text", F.regexp_replace("text", symbols, "")).withColumn("op", F.lit("revise"))


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules, ["doc_id"]).select("doc_id", *quality.BASE, "base_failed", "kept")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(read(spark, sf_dir, "documents"))


def tokens(docs: DataFrame) -> DataFrame:
    """Encoded and decoded whole texts, as digests."""
    path = ranks_path()
    out = bpe.decode(bpe.encode(docs, path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


#: crc32 of the text ``s`` in DuckDB, bit by bit
CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(s, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b:
    list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _edit(x: str, cost: str, letters: str) -> str:
    """A state of the walk below, nine digits of cost and the audit, after one more edit."""
    return f"CASE WHEN {x} = '~' THEN '~' ELSE lpad((left({x}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || {x}[10:] || '{letters}' END"


@query("op11_conversation_repair", rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                                coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
hurt AS (SELECT conv_id, turn, role, text, {CRC32} % 20 AS x FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role,
                   CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hurt, unnest(range(CASE WHEN x = 3 THEN 2 ELSE 1 END)) WHERE x <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS k,
                  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM damaged),
seen AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth FROM placed),
faults AS (SELECT *, CASE WHEN tail = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM seen),
counts AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                  count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
-- cost in 9 digits and audit of the cheapest edits after k rows: nothing kept, an s, an open u, whole pairs; '~' is none
walk AS (SELECT conv_id, 0::BIGINT AS k, '000000000' AS z, '~' AS h, '~' AS u, '~' AS p FROM counts
  UNION ALL
  SELECT conv_id, k,
         {_edit('z1', '2', 'D')}, least({_edit('h1', '2', 'D')}, CASE WHEN ok AND r = 's' THEN {_edit('z1', 'extra', 'K')} ELSE '~' END),
         least({_edit('u1', '2', 'D')}, CASE WHEN ok THEN {_edit('o1', 'extra + 1', 'R')} ELSE '~' END, CASE WHEN ok AND r = 'u' THEN {_edit('o1', 'extra', 'K')} ELSE '~' END),
         least({_edit('p1', '2', 'D')}, CASE WHEN ok THEN {_edit('u1', 'extra + 1', 'R')} ELSE '~' END, CASE WHEN ok AND r = 'a' THEN {_edit('u1', 'extra', 'K')} ELSE '~' END)
  FROM (SELECT *, least(z1, h1, p1) AS o1 FROM (
          SELECT w.conv_id, f.k, left(f.role, 1) AS r, f.fault IN ('t', '-') AS ok, CASE f.fault WHEN 't' THEN 5 ELSE 0 END AS extra,
                 z AS z1, h AS h1, least(u, {_edit('z', '5', 'I')}, {_edit('h', '5', 'I')}, {_edit('p', '5', 'I')}) AS u1, least(p, {_edit('u', '5', 'I')}, {_edit('z', '10', 'II')}, {_edit('h', '10', 'II')}) AS p1
          FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1))),
best AS (SELECT c.*, least(z, p, {_edit('u', '5', 'I')}, {_edit('h', '10', 'II')}) AS b FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.k),
plans AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, left(b, 9)::BIGINT AS cost, b[10:] AS audit FROM best),
edits AS (SELECT conv_id, e, pos, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS k
          FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(length(audit))) AS pos FROM plans WHERE audit <> '')),
kept AS (SELECT e.conv_id, e.e, e.pos, f.role, CASE WHEN e.e = 'I' THEN '' ELSE f.text END AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY pos) AS q
         FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = e.k WHERE e.e <> 'D'),
headed AS (SELECT *, max(CASE WHEN q = 1 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS head FROM kept),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (q - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS t
          FROM headed GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM o.conv_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return repair.report(rows, repair.damage(rows))


@query("op12_prefix_trie", rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)),
rebuilt AS (SELECT c.conv_id, 0 AS part, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.k <= c.h
            UNION ALL SELECT c.conv_id, 1, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
steps AS (SELECT conv_id, row_number() OVER o AS depth, text, string_agg(md5(length(role) || ':' || role || text), '') OVER o AS path
          FROM rebuilt WINDOW o AS (PARTITION BY conv_id ORDER BY part, k)),
every AS (SELECT conv_id, depth, text, path FROM steps UNION ALL SELECT conv_id, 0, '', '' FROM c),
sizes AS (SELECT conv_id, max(depth) AS d FROM every GROUP BY conv_id),
nodes AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(text) AS text,
                 string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = d) AS ends FROM every JOIN sizes USING (conv_id) GROUP BY path),
own AS (SELECT n.*, p.conv_id AS parent_conv_id, (n.n_convs - 1) * len(regexp_extract_all(n.text, '[^\x20\x09-\x0D]+')) AS saved FROM nodes n
        LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1))),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (SELECT left(path, 32 * up) AS path, sum(saved) AS saved, count(*) FILTER (NOT inner_node) AS leaves
          FROM (SELECT o.path, o.saved, k.path IS NOT NULL AS inner_node, unnest(range(o.depth + 1)) AS up FROM own o LEFT JOIN kids k USING (path)) GROUP BY ALL)
SELECT o.conv_id, o.depth::BIGINT AS depth, o.parent_conv_id, o.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(o.ends, '')) AS ends_sha256
FROM own o JOIN below b USING (path) LEFT JOIN kids k USING (path)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(read(spark, sf_dir, "conversations"))


@query("op13_license_scans")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(read(spark, sf_dir, "documents"), ["doc_id"])).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
