"""SQL of the numbered queries that SQL can express, for DuckDB."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATED_PHRASES = rf"""
WITH words AS (
    SELECT row, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (
        SELECT row_number() OVER () AS row, doc_id,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    )
),
windows AS (
    SELECT row, doc_id, i, word, CASE WHEN count(*) OVER ahead = 35 THEN md5(string_agg(word, ' ') OVER ahead) END AS passage
    FROM words
    WINDOW ahead AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
),
repeated AS (SELECT passage FROM windows WHERE passage IS NOT NULL GROUP BY passage HAVING count(*) > 1),
marked AS (
    SELECT row, doc_id, i, word, max(CASE WHEN r.passage IS NULL THEN 0 ELSE 1 END)
        OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
    FROM windows LEFT JOIN repeated r USING (passage)
),
kept AS (
    SELECT row, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
        string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS text
    FROM marked GROUP BY row
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(k.text, '')) AS kept_sha256
FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN kept k USING (row)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(digest, {{start}}, 5))::BIGINT >> {shift}) & 31) + 1)::INTEGER, 1)"
    for shift in (15, 10, 5, 0)
)

ARC_TO_WARC = f"""
WITH payloads AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS digest
    FROM pages
),
firsts AS (SELECT digest, payload_bytes, min(page_id) AS first FROM payloads GROUP BY digest, payload_bytes)
SELECT page_id, payload_bytes, {" || ".join(_BASE32.format(start=s) for s in range(1, 41, 5))} AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads JOIN firsts USING (digest, payload_bytes)
"""

# CRC-32 of an ASCII string, bit by bit.
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({}, ''),
        lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, v: CASE WHEN v >= 0 THEN xor(a, v)
        ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295::BIGINT)"""

PREFIX_TRIE = rf"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS nth,
        sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
    SELECT conv_id, list(digest ORDER BY nth) AS digests, list(words ORDER BY nth) AS words,
        {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS h
    FROM turns GROUP BY conv_id
),
rebuilt AS (
    SELECT o.conv_id,
        list_concat(coalesce(b.digests, [])[1:o.h], o.digests[o.h + 1:]) AS digests,
        list_concat(coalesce(b.words, [])[1:o.h], o.words[o.h + 1:]) AS words
    FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
),
members AS (
    SELECT conv_id, depth, sha256(array_to_string(digests[1:depth], ',')) AS node,
        CASE WHEN depth = 0 THEN 0 ELSE words[depth] END AS words, depth = len(digests) AS ends,
        CASE WHEN depth > 0 THEN sha256(array_to_string(digests[1:depth - 1], ',')) END AS above
    FROM (SELECT *, unnest(range(0, len(digests) + 1)) AS depth FROM rebuilt)
),
nodes AS (
    SELECT node, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * any_value(words) AS own,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY node, depth
),
children AS (SELECT above AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above, depth),
totals AS (
    SELECT m.node, m.depth, sum(n.own) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
    FROM nodes n
    JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
    LEFT JOIN children c ON c.node = n.node AND c.depth = n.depth
    GROUP BY m.node, m.depth
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
    coalesce(c.n, 0) AS n_children, t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t USING (node, depth)
LEFT JOIN nodes p ON p.node = n.above AND p.depth = n.depth - 1
LEFT JOIN children c ON c.node = n.node AND c.depth = n.depth
"""

RANKED_SEARCH = rf"""
WITH doc_terms AS (
    SELECT row, doc_id, unnest(terms) AS term, len(terms) AS n
    FROM (
        SELECT row_number() OVER () AS row, doc_id,
            regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    )
),
counts AS (SELECT row, doc_id, term, n, count(*) AS tf FROM doc_terms GROUP BY ALL),
whole AS (SELECT count(DISTINCT row) AS nd, count(*) AS total FROM doc_terms),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
    FROM counts, whole GROUP BY term, nd
),
impacts AS (
    SELECT row, doc_id, term,
        (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // total))) AS impact
    FROM counts, whole
),
item_terms AS (
    SELECT item, item_id, term, count(*) AS q
    FROM (
        SELECT item, item_id, unnest(regexp_extract_all({_LOWER.format("text")},
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
    )
    GROUP BY ALL
),
scores AS (
    SELECT item, item_id, row, doc_id, CAST(sum(q * w * impact) AS BIGINT) AS score
    FROM item_terms JOIN weights USING (term) JOIN impacts USING (term)
    GROUP BY ALL
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20
"""

MINHASH = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words
),
entries AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b USING (shingle)
    WHERE a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
    doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM sets LEFT JOIN least USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_repeated_phrases": REPEATED_PHRASES,
    "op3_arc_to_warc": ARC_TO_WARC,
    "op11_prefix_trie": PREFIX_TRIE,
    "op12_ranked_search": RANKED_SEARCH,
    "op13_minhash": MINHASH,
}
