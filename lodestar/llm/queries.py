"""The queries opN_<name> over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .shared import table


def op1_simhash(spark, sf_dir):
    from .simhash import simhash

    groups = simhash(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_quality(spark, sf_dir):
    from .quality import quality

    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "score", "content_score", "metadata_score", "keep")


def op3_decontaminate(spark, sf_dir):
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op5_token_store(spark, sf_dir):
    import public_tokenizers

    from .token_store import token_store

    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_line_dedup(spark, sf_dir):
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counted="removed_lines")


def op7_language_id(spark, sf_dir):
    from .language_id import language_id

    rest = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 3
    docs = table(spark, sf_dir, "documents")
    found = language_id(docs, rest(F.col("doc_id")) != 1)
    return found.select("doc_id", (rest(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


def op8_chat_windows(spark, sf_dir):
    from .chat_windows import chat_windows, read_back
    from .shared import Scratch

    says = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -7L as conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role), '{says}' as text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(Scratch(spark, "chat").write(chat_windows(turns), "windows"))


def op9_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_pieces(spark, sf_dir):
    import public_tokenizers

    from .pieces import decode, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    read = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_token_store": op5_token_store,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_chat_windows": op8_chat_windows,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pieces": op10_pieces,
}

PUNCT = """.,;:!?"''()[]{}<>|*-_#"""

ORACLE = {
    # every diagonal of every item and document by the words that are equal in place
    "op3_decontaminate": rf"""
        WITH d AS (SELECT doc_id AS id, list_filter(list_transform(regexp_extract_all(lower(text), '[^\s]+'), lambda w: trim(w, '{PUNCT}')), lambda w: w <> '') AS ws FROM documents),
        b AS (SELECT item_id AS id, list_filter(list_transform(regexp_extract_all(lower(text), '[^\s]+'), lambda w: trim(w, '{PUNCT}')), lambda w: w <> '') AS ws FROM benchmark),
        x AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS at FROM d),
        y AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS at, len(ws) AS n FROM b),
        g AS (SELECT x.id AS doc_id, y.id AS item_id, x.at - y.at AS start, y.n AS n_words, count(*) AS n_equal FROM x JOIN y ON x.w = y.w GROUP BY ALL HAVING count(*) >= 0.8 * y.n),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start) AS k FROM g)
        SELECT doc_id, item_id, start, n_equal, n_words, n_equal / n_words AS similarity FROM r WHERE k = 1""",
    # words of training documents, else for each character the longest n-gram seen
    "op7_language_id": r"""
        WITH c AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
        h AS (SELECT doc_id, lang, text, hex(encode(doc_id::VARCHAR)) AS h FROM documents),
        d AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS ws,
                     xor(4294967295, list_reduce(list_transform(range(0, length(h), 2), lambda k: CAST('0x' || h[k + 1 : k + 2] AS BIGINT)), lambda a, x: xor(a // 256, t[(xor(a % 256, x) + 1)]), 4294967295)) % 3 = 1 AS held_out FROM h, c),
        tok AS (SELECT doc_id, unnest(ws) AS w FROM d),
        words AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(ws) AS w FROM d WHERE lang IS NOT NULL AND NOT held_out) GROUP BY ALL),
        langs AS (SELECT DISTINCT lang FROM words),
        wbase AS (SELECT lang, ln(sum(n) + 0.5 * count(*) + 1) AS base FROM words GROUP BY lang),
        known AS (SELECT DISTINCT w FROM words),
        kscore AS (SELECT k.w, l.lang, ln(coalesce(t.n, 0) + 0.5) - b.base AS s FROM known k CROSS JOIN langs l JOIN wbase b ON b.lang = l.lang LEFT JOIN words t ON t.w = k.w AND t.lang = l.lang),
        marked AS (SELECT lang, chr(2) || w || chr(3) AS s FROM words),
        cut AS (SELECT lang, s, unnest(range(1, 6)) AS k FROM marked),
        grams AS (SELECT lang, g, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, length(s) - k + 2), lambda i: substr(s, i, k))) AS g FROM cut) GROUP BY ALL),
        gbase AS (SELECT lang, length(g) AS k, ln(sum(n) + 0.5 * count(*) + 1) AS base FROM grams GROUP BY ALL),
        gknown AS (SELECT DISTINCT g FROM grams),
        unknown AS (SELECT DISTINCT w, chr(2) || w || chr(3) AS s FROM tok WHERE w NOT IN (SELECT w FROM known)),
        ends AS (SELECT w, s, unnest(range(2, length(s) + 1)) AS e FROM unknown),
        suffixes AS (SELECT w, s, e, unnest(range(1, least(5, e) + 1)) AS k FROM ends),
        longest AS (SELECT w, e, max(k) AS k FROM suffixes JOIN gknown ON g = substr(s, e - k + 1, k) GROUP BY ALL),
        each AS (SELECT x.w, l.lang, CASE WHEN b.k IS NULL THEN 5 * ln(0.4) - 10 ELSE ln(coalesce(g.n, 0) + 0.5) - coalesce(q.base, 0) + (5 - b.k) * ln(0.4) END AS s
                 FROM ends x LEFT JOIN longest b ON b.w = x.w AND b.e = x.e CROSS JOIN langs l
                 LEFT JOIN grams g ON g.g = substr(x.s, x.e - b.k + 1, b.k) AND g.lang = l.lang LEFT JOIN gbase q ON q.lang = l.lang AND q.k = b.k),
        scores AS (SELECT w, lang, avg(s) AS s FROM each GROUP BY ALL UNION ALL SELECT * FROM kscore),
        total AS (SELECT doc_id, s.lang, sum(s.s) AS s FROM tok JOIN scores s ON s.w = tok.w GROUP BY ALL),
        top AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS best FROM total),
        found AS (SELECT doc_id, min(lang) FILTER (WHERE s = best) AS lang, 1 / sum(exp(s - best)) AS score FROM top GROUP BY doc_id)
        SELECT d.doc_id, held_out, coalesce(f.lang, 'und') AS lang_pred, round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN found f ON f.doc_id = d.doc_id""",
    "op8_chat_windows": """
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        i AS (SELECT *, row_number() OVER w - 1 AS idx, ceil(strlen(text) / 4)::BIGINT + 4 AS tokens FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        h AS (SELECT *, role = 'system' AND idx = 0 AS head FROM i),
        n AS (SELECT *, sum(CASE WHEN head THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY idx)::BIGINT AS upto,
                     max(CASE WHEN head THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS top,
                     8 + length(replace(replace(replace(replace(role, '\\', '\\0'), '<', '\\1'), '[', '\\2'), chr(10), '\\3'))
                       + length(replace(replace(replace(text, '\\', '\\0'), '<', '\\1'), '[', '\\2')) AS chars FROM h),
        b AS (SELECT *, upto - CASE WHEN head THEN 0 ELSE tokens END AS before FROM n),
        r AS (SELECT conv_id, idx, before AS base FROM b WHERE idx = CASE WHEN top > 0 THEN 1 ELSE 0 END
              UNION ALL SELECT b.conv_id, b.idx, CASE WHEN b.upto - r.base > greatest(1024 - 256 - b.top, 1) THEN b.before ELSE r.base END
                        FROM r JOIN b ON b.conv_id = r.conv_id AND b.idx = r.idx + 1),
        s AS (SELECT conv_id, base, min(idx) AS first, max(idx) AS last FROM r GROUP BY conv_id, base
              UNION ALL SELECT conv_id, 0, 0, 0 FROM b GROUP BY conv_id HAVING count(*) = 1 AND bool_or(head)),
        f AS (SELECT s.conv_id, sum(b.chars)::BIGINT AS formatted_chars FROM s JOIN b ON b.conv_id = s.conv_id
              AND (b.head OR b.idx BETWEEN s.first AND s.last OR (NOT b.head AND b.idx < s.first AND b.before >= s.base - 256)) GROUP BY s.conv_id)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
        FROM b JOIN f USING (conv_id) GROUP BY conv_id""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER} AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM d JOIN g USING (body)""",
}
