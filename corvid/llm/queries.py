"""Named queries of the operators, with DuckDB SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import convtrie, decontaminate, exactdup, html_text, linededup, lmscore, pack, simhash, spelling, suffixdedup, tokencount, toxicity, warc


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the main text (see ``html_text``)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).select("page_id", "url", "text", "n_chars")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: probability of each category and the toxic decision (see ``toxicity``)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.corpus_chain(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).withColumn("toxic", F.col("p_toxic") >= toxicity.THRESHOLD)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words inside benchmark windows, the items hit (see ``decontaminate``)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document: its place in a sequence (see ``pack``)."""
    return pack.pack(read_table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: stupid-backoff score under all other documents (see ``lmscore``)."""
    scored = lmscore.score_documents(read_table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("log10_score", "score")})


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: SimHash fingerprint and near-duplicate component (see ``simhash``)."""
    return simhash.near_groups(read_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the copy that stays, group size, digest (see ``exactdup``)."""
    return exactdup.exact_groups(read_table(spark, sf_dir, "documents"), keep="largest")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes and tokens (see ``tokencount``)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines taken out, digest of the text left (see ``linededup``)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, chars_per_edit=linededup.CHARS_PER_EDIT).select(
        "doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its record as read back from the written archives (see ``warc``)."""
    return warc.archive_digest(read_table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word of the corpus: its near words, form and root (see ``spelling``)."""
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes taken out as repeats of an earlier document, digest of the rest (see ``suffixdedup``)."""
    cut_docs = suffixdedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    left = F.octet_length("kept").cast("long")
    return cut_docs.select("doc_id", "n_bytes", (F.col("n_bytes") - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                           F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per trie node of the rebuilt conversations: members, children, leaves, saved tokens, ends (see ``convtrie``)."""
    return convtrie.shared_prefixes(read_table(spark, sf_dir, "conversations")).drop("path", "parent_path")


QUERIES = {f.__name__: f for f in (
    op1_main_text, op2_toxicity, op3_decontaminate, op4_pack, op5_lm_score, op6_simhash_groups, op7_exact_dedup, op8_token_counts,
    op9_line_dedup, op10_warc, op11_spelling_variants, op12_suffix_dedup,
    op13_conversation_trie)}


def _crc32(text: str) -> str:
    """Unsigned crc32 of a string in UTF-8."""
    step = "lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), "
            f"lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), {step})), 4294967295)")


_LOWER = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLES: dict[str, str] = {
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
 i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_words('text')} AS w FROM benchmark),
 iw AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
        FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) r(k) WHERE len(w) > 0),
 dw AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
        FROM d, (SELECT DISTINCT size FROM iw) z, unnest(range(1, len(w) - size + 2)) r(k)),
 m AS (SELECT doc_id, dw.size, k, item FROM dw JOIN iw USING (size, win)),
 h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT doc_id, size, k FROM m)) GROUP BY 1),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op5_lm_score": f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
 p AS (SELECT doc_id, unnest(w) AS g1, generate_subscripts(w, 1) AS pos, len(w) AS n_words FROM d),
 g AS (SELECT *, lag(g1) OVER o || ' ' || g1 AS g2, lag(g1, 2) OVER o || ' ' || lag(g1) OVER o || ' ' || g1 AS g3
       FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
 c AS (SELECT doc_id, pos, n_words, (SELECT count(*) FROM p) - n_words AS others,
  count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY g1, doc_id) AS c1,
  count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY g2, doc_id) AS c2,
  count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY g3, doc_id) AS c3 FROM g),
 l AS (SELECT *, lag(c1) OVER o AS b1, lag(c2) OVER o AS b2, least(2, pos - 1) AS top FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
 s AS (SELECT doc_id, CASE WHEN pos >= 3 AND c3 > 0 THEN log10(c3 / b2)
   WHEN pos >= 2 AND c2 > 0 THEN log10(c2 / b1) + (top - 1) * log10(0.4)
   WHEN c1 > 0 THEN log10(c1 / others) + top * log10(0.4)
   ELSE -log10(greatest(others, 1)) + (top + 1) * log10(0.4) END AS score,
   NOT (pos >= 3 AND c3 > 0) AND NOT (pos >= 2 AND c2 > 0) AND c1 = 0 AS unseen FROM l),
 t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE unseen) AS n_unseen, sum(score) AS total FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_unseen, 0) AS n_unseen, round(coalesce(total, 0.0), 6) AS log10_score,
       round(total / n_words, 6) AS score
FROM d LEFT JOIN t USING (doc_id)""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
 f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_spelling_variants": f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all({_LOWER.format(text='text')}, '[a-zÀ-ÿ]+')) AS w FROM documents),
 c AS (SELECT d || ':' || w AS dw, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY 1, 2),
 h AS (SELECT w, n, {_crc32('dw')} AS h FROM c),
 k AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
 words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
 v AS (SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS cut FROM words, unnest(range(length(word) + 1)) t(i)),
 near AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.cut = b.cut AND a.word <> b.word
          WHERE a.i = b.i AND a.i > 0 OR a.i = 0 AND b.i > 0 OR a.i > 0 AND b.i = 0),
 best AS (SELECT word, count(*) AS n_near, list({{'w': near, 'n': near_n}} ORDER BY near_n DESC, near)[1] AS top FROM near GROUP BY 1),
 f AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 5 * n THEN top.w END AS form, CASE WHEN top.n >= 5 * n THEN top.n END AS form_n
       FROM words LEFT JOIN best USING (word)),
 chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain USING (word) JOIN f g ON g.word = chain.at AND g.form IS NULL""",
    "op12_suffix_dedup": """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
 x AS (SELECT r, doc_id, hex(b) AS x, octet_length(b) AS n FROM t),
 p AS (SELECT r, doc_id, n, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN i + 50 <= n THEN substr(x, 2 * i + 1, 100) END AS s FROM x, unnest(range(n)) u(i)),
 m AS (SELECT s, min(doc_id) AS first FROM p WHERE s IS NOT NULL GROUP BY 1),
 f AS (SELECT r, n, i, byte, coalesce(m.first < p.doc_id OR m.first IS NOT NULL AND p.doc_id IS NULL, false) AS hit FROM p LEFT JOIN m USING (s)),
 g AS (SELECT r, n, i, byte, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS 49 PRECEDING) AS gone FROM f),
 e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM g),
 d AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
              coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM x LEFT JOIN d USING (r)""",
    "op13_conversation_trie": f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT c, md5(length(r)::VARCHAR || ':' || r || x) AS m, length(x) AS n,
              row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(r)::VARCHAR || ':' || r || x)) - 1 AS pos FROM t),
 v AS (SELECT c, {_crc32("c::VARCHAR")} % 6 AS h, c - c % 100 AS base, n_own FROM (SELECT c, count(*) AS n_own FROM t GROUP BY 1)),
 w AS (SELECT v.*, least(v.h, coalesce(b.n_own, 0)) AS taken FROM v LEFT JOIN v b ON b.c = v.base),
 q AS (SELECT w.c, o.pos, o.m, o.n FROM w JOIN o ON o.c = w.base AND o.pos < w.h
       UNION ALL SELECT w.c, w.taken + o.pos - w.h, o.m, o.n FROM w JOIN o ON o.c = w.c AND o.pos >= w.h),
 k AS (SELECT c, pos + 1 AS d, n, md5(array_to_string(list(m) OVER (PARTITION BY c ORDER BY pos), ' ')) AS key FROM q),
 e AS (SELECT c, d, n, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), '') AS parent FROM k
       UNION ALL SELECT c, 0, 0, '', NULL FROM w),
 z AS (SELECT key, any_value(parent) AS parent, any_value(d) AS d, any_value(n) AS n, min(c) AS low, count(*) AS n_convs FROM e GROUP BY key),
 y AS (SELECT parent, count(*) AS n_children FROM z WHERE parent IS NOT NULL GROUP BY 1),
 u AS (SELECT z.*, coalesce(y.n_children, 0) AS n_children FROM z LEFT JOIN y ON y.parent = z.key),
 s AS (SELECT e.key, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.n) AS saved
       FROM u JOIN e ON e.c = u.low AND e.d <= u.d GROUP BY 1),
 f AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM e WHERE d = (SELECT max(d) FROM e x WHERE x.c = e.c) GROUP BY 1)
SELECT u.low AS conv_id, u.d AS depth, p.low AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(f.ends, '')) AS ends_sha256
FROM u JOIN s USING (key) LEFT JOIN f USING (key) LEFT JOIN z p ON p.key = u.parent""",
}
