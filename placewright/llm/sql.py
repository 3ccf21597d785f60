"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from placewright.llm.license_scan import Settings, templates

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

EXACT_DEDUP = f"""
    WITH t AS (SELECT doc_id, {_LOWER} AS text FROM documents),
    g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size, sha256(text) AS text_sha256 FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

#: Checksums of all distinct features grow by one byte a step of the recursion.
RESAMPLING = f"""
    WITH RECURSIVE shift AS (
        SELECT n::BIGINT AS n, list_reduce(list_prepend(n::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) r(n)),
    w AS MATERIALIZED (
        SELECT 0 AS side, doc_id AS id, {_TERMS} AS ws FROM documents
        UNION ALL SELECT 1, item_id, {_TERMS} FROM benchmark),
    f AS MATERIALIZED (
        SELECT side, id, unnest(ws) AS feature FROM w
        UNION ALL SELECT side, id, unnest(list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2])) FROM w WHERE len(ws) > 1),
    d AS (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM f),
    crc AS (
        SELECT feature, h, 0 AS i, 4294967295::BIGINT AS c FROM d
        UNION ALL
        SELECT feature, h, i + 1, xor(c >> 8, v) FROM crc JOIN shift ON n = xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) & 255 WHERE 2 * i < length(h)),
    b AS (SELECT feature, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * i = length(h)),
    m AS MATERIALIZED (SELECT side, id, bucket FROM f JOIN b USING (feature)),
    g AS (
        SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain
        FROM (SELECT bucket, (count(*) FILTER (side = 0))::DOUBLE AS s, (count(*) FILTER (side = 1))::DOUBLE AS t FROM m GROUP BY bucket),
             (SELECT count(*) FILTER (side = 0) AS all_s, count(*) FILTER (side = 1) AS all_t FROM m)),
    x AS (SELECT id, sum(gain) AS gain FROM m JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
    s AS (
        SELECT id AS doc_id, len(ws) AS n_words, len(ws) + greatest(len(ws) - 1, 0) AS n_features,
            coalesce(floor(gain / (len(ws) + greatest(len(ws) - 1, 0))), 0)::BIGINT AS weight,
            floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
        FROM w LEFT JOIN x USING (id) WHERE side = 0),
    r AS (
        SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM s WHERE n_words >= 20)
    SELECT doc_id, n_features::BIGINT AS n_features, weight, weight + noise AS score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM s LEFT JOIN r USING (doc_id)
"""

RANKED_SEARCH = f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS ws FROM documents),
    n AS (SELECT count(*) FILTER (len(ws) > 0) AS docs, sum(len(ws))::BIGINT AS total FROM d),
    tf AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, n GROUP BY term, docs),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    s AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * docs) // total))))::BIGINT AS score
        FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""


def license_scan(settings: Settings = Settings()) -> str:
    """Every block against every template, without any filter."""
    values = ", ".join(f"('{t.label}', {t.tokens}, {t.needed}, {t.words}, {str(t.phrase).lower()})" for t in templates(settings))
    return f"""
        WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS ws FROM documents),
        t(label, tokens, needed, ws, phrase) AS (VALUES {values}),
        b AS (
            SELECT doc_id, list_slice(ws, s + 1, s + {settings.block + settings.overlap}) AS block
            FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws), 1), {settings.block})) AS s FROM d)),
        n AS (
            SELECT doc_id, label, max(len(list_intersect(tokens, block)) / len(tokens)) AS part
            FROM b, t WHERE NOT phrase AND len(list_intersect(tokens, block)) >= needed GROUP BY doc_id, label),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
        h AS (SELECT doc_id, label, t.ws AS phrase, i FROM w JOIN t ON word = t.ws[1] WHERE phrase),
        p AS (SELECT doc_id, label, i - 1 AS pos FROM h JOIN d USING (doc_id) WHERE list_slice(ws, i, i + len(h.phrase) - 1) = h.phrase),
        x AS (
            SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
            FROM p GROUP BY doc_id),
        l AS (
            SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score
            FROM (SELECT doc_id, label, part FROM n UNION ALL SELECT doc_id, label, 1.0 FROM p) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM d LEFT JOIN x USING (doc_id) LEFT JOIN l USING (doc_id)
    """
