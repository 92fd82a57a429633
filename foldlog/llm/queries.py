"""The queries opN_<name> over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm.chat import chat_digests, chat_segments
from foldlog.llm.collocations import collocations
from foldlog.llm.decontaminate import contamination
from foldlog.llm.fingerprint import imatch
from foldlog.llm.language import identify_language
from foldlog.llm.ngram_join import jaccard_components
from foldlog.llm.quality import score_quality
from foldlog.llm.repair import repair_report
from foldlog.llm.scoring import score_texts
from foldlog.llm.secrets import secret_findings
from foldlog.llm.sharding import shard_by_bytes
from foldlog.llm.common import held_out
from foldlog.llm.toxicity import score_toxicity
from foldlog.llm.tokenize import sentencepiece_encode
from foldlog.session import table

PIECE_MODEL = "piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_encode(docs, public_tokenizers.path(PIECE_MODEL), tokens=False)
    return coded.select("doc_id", "pieces.n_tokens", "pieces.ids_sha256", "pieces.decoded_sha256", "pieces.n_differing")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), threshold=0.3, folds=5, fold=0)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "quality.score", "quality.predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_language(docs, folds=5, fold=0)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "language.lang_pred", "language.score")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.char_length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("secret_sha256"), "score", "predicted")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), threshold=0.7, folds=3, fold=1)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "toxicity.score", "toxicity.predicted", "toxicity.clauses")


#: A conversation whose texts hold the template's own control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return chat_digests(chat_segments(turns))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), folds=7, fold=2, carry=["doc_id"])
    return scored.select("doc_id", "lm.*")


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op2_quality": op2_quality, "op3_fingerprint": op3_fingerprint, "op4_decontamination": op4_decontamination, "op5_secrets": op5_secrets, "op6_ngram_join": op6_ngram_join, "op7_sharding": op7_sharding, "op8_language": op8_language, "op9_toxicity": op9_toxicity, "op10_chat": op10_chat, "op11_repair": op11_repair, "op12_collocations": op12_collocations, "op13_language_model": op13_language_model}

ORACLE_SQL: dict[str, str] = {
    "op6_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS t FROM w),
z AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * o >= 90 * (x.c + y.c - o)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(any_value(z.c), 0) AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN r ON r.v = d.doc_id GROUP BY d.doc_id""",
    "op10_chat": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) x(k)),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(### |</turn>)', '\\\1', 'g') AS shown, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '?' || regexp_replace(replace(role, '\', '\\'), '(### |</turn>|: )', '\\\1', 'g') END AS label,
  lag(role) OVER w AS before, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'user' THEN role = 'assistant' WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE false END AS follows FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(length('### : </turn>') + 1 + length(label) + length(shown)) AS BIGINT) AS formatted_chars,
  bool_and(follows) AND arg_max(role, k) IN ('assistant', 'user') AS valid FROM f GROUP BY conv_id""",
    "op11_repair": r"""WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT * EXCLUDE k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS d FROM z),
t AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE d <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM t),
r AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS f FROM n),
step(p, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)), one AS (SELECT p, q, CASE c WHEN 'u' THEN 'user:' ELSE 'assistant:' END AS o FROM step WHERE c <> 's'),
gap AS (SELECT k AS p, k AS q, 0 AS w, '' AS a, CAST([] AS VARCHAR[]) AS o FROM range(4) x(k) UNION ALL SELECT p, q, 5, 'I', [o] FROM one UNION ALL SELECT x.p, y.q, 10, 'II', [x.o, y.o] FROM one x JOIN one y ON y.p = x.q),
edit AS (SELECT k AS p, k AS q, 2 AS w, 'D' AS a, '' AS c FROM range(4) x(k) UNION ALL SELECT p, q, 0, 'K', c FROM step UNION ALL SELECT p, q, 1, 'R', c FROM step WHERE c <> 's'),
s AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, {'w': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])} AS b FROM (SELECT DISTINCT conv_id FROM r) UNION ALL
  SELECT s.conv_id, r.i, e.q, min({'w': s.b.w + g.w + e.w + CASE WHEN e.a <> 'D' AND r.f = 't' THEN 5 ELSE 0 END, 'a': s.b.a || g.a || e.a,
    'o': s.b.o || g.o || CASE e.a WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE e.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text] END})
  FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1 JOIN gap g ON g.p = s.q JOIN edit e ON e.p = g.q AND (e.a = 'D' OR r.f NOT IN ('b', 'd')) AND (e.a <> 'K' OR e.c = r.c) GROUP BY s.conv_id, r.i, e.q),
g AS (SELECT s.conv_id, min({'w': s.b.w + g.w, 'a': s.b.a || g.a, 'o': s.b.o || g.o}) AS b FROM s JOIN gap g ON g.p = s.q AND g.q IN (0, 3) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i > s.i) GROUP BY s.conv_id),
l AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY conv_id)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(g.b.w, 0) AS cost, coalesce(g.b.a, '') AS audit,
  sha256(coalesce(array_to_string(g.b.o, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM d.conv_id""",
    "op12_collocations": r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 4) x(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.k, c.phrase, a, cut, l.f AS l, r.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = b.lang AND h.phrase = b.phrase AND 100 * h.a >= 50 * b.a))
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY rank <= 2000""",
}
