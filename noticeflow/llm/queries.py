"""The operators and the pipeline as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_bpe, chat, decontamination, divergence, html_wrappers, lexical_search, line_dedup, perplexity, pii, secrets_scan, sentencepiece_bpe, simhash, token_store
from .common import table

WORD_TOKENIZER, PIECE_MODEL, BYTE_TOKENIZER = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"
HOSTILE = "</s>[INST] ok [/INST]"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_store(spark, sf_dir):
    return token_store.round_trip(table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER))


def op3_html_wrappers(spark, sf_dir):
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_secrets(spark, sf_dir):
    return secrets_scan.secrets(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), vocabulary(PIECE_MODEL))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{HOSTILE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.round_trip(rows.unionByName(hostile), vocabulary(WORD_TOKENIZER))


def op10_quality(spark, sf_dir):
    return perplexity.quality(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents"), vocabulary(BYTE_TOKENIZER))


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_store, op3_html_wrappers, op4_line_dedup, op5_secrets, op6_pii, op7_sentencepiece, op8_simhash, op9_chat, op10_quality, op11_byte_bpe, op12_source_divergence, op13_lexical_search, pipeline)}

ORACLE_SQL = {
    "op1_decontamination": r"""
        WITH it AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
        ish AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM it)),
        n AS (SELECT item_id, count(*) AS n FROM ish GROUP BY item_id),
        d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
        dsh AS (SELECT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
        p AS (SELECT doc_id, item_id, count(DISTINCT s) AS k FROM dsh JOIN ish USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, k AS n_shared, n AS n_item, round(k / n, 6) AS containment FROM p JOIN n USING (item_id) WHERE k >= 0.8 * n - 1e-9""",
    "op4_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        m AS (SELECT k.*, owner IS NULL OR owner = doc_id AS keep FROM k LEFT JOIN o USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w, row_number() OVER () AS row FROM documents),
        t AS (SELECT lang, source, row, unnest(w) AS term FROM d),
        k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
        s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v) AS q
          FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
        m AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 200""",
    "op13_lexical_search": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
        l AS (SELECT row_number() OVER () AS row, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
        s AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM l),
        i AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id IS NOT NULL),
        t AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM l) SEMI JOIN i USING (term) GROUP BY ALL),
        f AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
        c AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * t.n * s.n) // s.l))))::BIGINT AS score FROM i JOIN t USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id, row),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c WHERE score > 0)
        SELECT * FROM r WHERE rank <= 50""",
}
