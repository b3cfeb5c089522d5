"""The queries of this folder, by name, and their SQL."""

from __future__ import annotations

from orrery.llm.bpe import op7_bpe
from orrery.llm.decontaminate import op4_decontaminate
from orrery.llm.jaccard import op6_jaccard
from orrery.llm.langid import op2_langid
from orrery.llm.pii import op1_pii
from orrery.llm.quality import op10_quality
from orrery.llm.tokenfiles import op9_token_files
from orrery.llm.toxicity import op8_toxicity
from orrery.llm.urlfilter import op5_url_filter
from orrery.llm.warc import op3_warc


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_langid": op2_langid,
        "op3_warc": op3_warc,
        "op4_decontaminate": op4_decontaminate,
        "op5_url_filter": op5_url_filter,
        "op6_jaccard": op6_jaccard,
        "op7_bpe": op7_bpe,
        "op8_toxicity": op8_toxicity,
        "op9_token_files": op9_token_files,
        "op10_quality": op10_quality,
    }


#: SHA-1 in base 32: the digest's bits in fives.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), b AS (SELECT *, from_hex(sha1(h))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INTEGER + 8 * substr(bits, 5 * i + 2, 1)::INTEGER
 + 4 * substr(bits, 5 * i + 3, 1)::INTEGER + 2 * substr(bits, 5 * i + 4, 1)::INTEGER + substr(bits, 5 * i + 5, 1)::INTEGER, 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b"""

#: Links by shared shingles, components by a recursive walk over links between classes of equal sets.
JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
c AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(10)))) ELSE doc_id END AS rep, s FROM s),
k AS (SELECT rep, any_value(n) AS n, count(*) AS copies FROM c WHERE n > 0 GROUP BY rep),
x AS (SELECT rep, unnest(s) AS g FROM c WHERE doc_id = rep),
e AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2
 HAVING 100 * count(*) >= 90 * ((SELECT n FROM k WHERE k.rep = a.rep) + (SELECT n FROM k WHERE k.rep = b.rep) - count(*))),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, least(a, min(b)) AS root FROM r GROUP BY a), l AS (SELECT a, sum(copies) AS links FROM e JOIN k ON e.b = k.rep GROUP BY a)
SELECT c.doc_id, c.n AS n_shingles, coalesce(m.root, c.rep) AS component_id, CAST(CASE WHEN c.n = 0 THEN 0 ELSE k.copies - 1 + coalesce(l.links, 0) END AS BIGINT) AS n_links
FROM c LEFT JOIN k USING (rep) LEFT JOIN m ON m.a = c.rep LEFT JOIN l ON l.a = c.rep"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": WARC_SQL, "op6_jaccard": JACCARD_SQL}
