"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    ann,
    decontam,
    hamming_tree,
    html_text,
    ngram_join,
    packing,
    periodic_runs,
    pii,
    ranked_search,
    secret_scan,
    toxicity,
    url_filter,
    warc,
)
from .shared import table

TOKENIZER = "word_bpe_49k.json"
SURROGATE_KEY = "corpus-2024"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_ngram_join(spark, d):
    return ngram_join.near_duplicates(table(spark, d, "documents"))


def op2_pii_surrogates(spark, d):
    return pii.surrogates(table(spark, d, "documents"), SURROGATE_KEY)


def op3_best_fit_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), tokenizer_path())


def op4_decontamination(spark, d):
    found = decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.drop("longest_match", "longest_at", "longest_item")


def toxicity_model(spark, docs, d):
    return toxicity.fit(docs, table(spark, d, "labels"), F.col("toxic"), refine=True)


def op5_toxicity(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity_model(spark, docs, d))


def op6_secrets(spark, d):
    return secret_scan.find_secrets(table(spark, d, "documents"))


def op7_html_text(spark, d):
    return html_text.main_texts(table(spark, d, "pages"))


URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
             ("allow", "org/fr/"))


def op8_url_filter(spark, d):
    return url_filter.judge(table(spark, d, "pages"), URL_RULES)


def op9_warc(spark, d):
    return warc.archived(table(spark, d, "pages"))


def op10_nearest_vectors(spark, d):
    return ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_ranked_search(spark, d):
    return ranked_search.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12_simhash_duplicates(spark, d):
    return hamming_tree.near_duplicates(table(spark, d, "documents"))


def op13_periodic_runs(spark, d):
    return periodic_runs.periodic_runs(table(spark, d, "documents"), repeat_tails=True)


QUERIES = {f.__name__: f for f in (
    op1_ngram_join, op2_pii_surrogates, op3_best_fit_packing, op4_decontamination, op5_toxicity,
    op6_secrets, op7_html_text, op8_url_filter, op9_warc, op10_nearest_vectors,
    op11_ranked_search, op12_simhash_duplicates, op13_periodic_runs)}

_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_PLAIN = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def _secrets_sql() -> str:
    """Entropy of every window anew, from lists of characters."""
    def located(kind, number, pattern, least, group=0):
        quoted = pattern.replace("'", "''")
        return f"""SELECT doc_id, '{kind}' AS kind, {number} AS k, i,
    list_sum([len(p) FOR p IN between[1 : i]]) + coalesce(list_sum([len(p) FOR p IN found[1 : i - 1]]), 0) AS s,
    found[i] AS m
  FROM (SELECT doc_id, string_split_regex(text, '{quoted}') AS between,
    regexp_extract_all(text, '{quoted}') AS found,
    regexp_extract_all(text, '{quoted}', {group}) AS v FROM texts), range(1, 100000) t(i)
  WHERE i <= len(found) AND len(v[i]) >= {least}"""

    assign = secret_scan.ASSIGN
    candidate = f"[A-Za-z0-9+/_=-]{{{secret_scan.WINDOW},}}"
    limits = " ".join(f"WHEN regexp_matches(m, '{form}') THEN {least if least else 99}"
                      for _, form, least in secret_scan.CLASSES)
    allowed = " OR ".join(f"regexp_matches(m, '{form}')" for form in secret_scan.ALLOWED_FORMS)
    usual = ", ".join(f"'{pair}'" for pair in secret_scan.USUAL_PAIRS)
    allowed += (" OR (regexp_matches(m, '^[A-Za-z]+$') AND 5 * len([1 FOR j IN range(1, len(m)) "
                f"IF lower(m[j : j + 1]) IN ({usual})]) >= 2 * (len(m) - 1))")
    w = secret_scan.WINDOW
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  {located("assign", 0, assign, 6, 1)}
  UNION ALL {located("access", 1, secret_scan.ACCESS, 20)}
  UNION ALL {located("hex", 2, secret_scan.HEX, 24)}),
tried AS (
  {located("entropy", 3, candidate, w)}),
clear AS (
  SELECT t.* FROM tried t WHERE NOT EXISTS (SELECT 1 FROM base b
    WHERE b.doc_id = t.doc_id AND b.s < t.s + len(t.m) AND t.s < b.s + len(b.m))),
measured AS (
  SELECT *, round(list_max([list_aggregate(string_split(m[j : j + {w - 1}], ''), 'entropy')
    FOR j IN range(1, len(m) - {w - 2})]), 9) AS bits, CASE {limits} END AS least FROM clear),
entropy AS (SELECT doc_id, kind, k, i, s, m FROM measured WHERE bits >= least AND NOT ({allowed})),
spans AS (
  SELECT doc_id, k, s, kind || ':' || s::BIGINT || ':' || (s + len(m))::BIGINT AS name
  FROM (SELECT * FROM base UNION ALL SELECT * FROM entropy)),
per AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
    count(*) FILTER (k = 3) AS e, string_agg(name, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    string_agg(name, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access,
  coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(e, 0)::BIGINT AS n_entropy
FROM documents d LEFT JOIN per USING (doc_id)"""


ORACLES = {
    "op1_ngram_join": rf"""WITH RECURSIVE worded AS (
  SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct([array_to_string(w[i : i + 4], ' ')
    FOR i IN range(1, greatest(len(w) - 4, 1) + 1)])) AS s FROM worded WHERE len(w) > 0),
copies AS (SELECT s, min(doc_id) AS rep, count(*) AS n, len(s) AS size FROM sets GROUP BY s),
grams AS (SELECT rep, n, size, unnest(s) AS g FROM copies),
pairs AS (
  SELECT a.rep AS x, b.rep AS y, any_value(b.n) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep HAVING 5 * count(*) >= 4 * (any_value(a.size) + any_value(b.size) - count(*))),
reach AS (SELECT rep AS x, rep AS y FROM copies UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
linked AS (SELECT x, sum(n) AS n FROM pairs GROUP BY x)
SELECT d.doc_id, coalesce(r.root, d.doc_id) AS class_id, coalesce(c.rep, d.doc_id) AS copy_id,
  (coalesce(l.n, 0) + coalesce(c.n, 1) - 1)::BIGINT AS n_links
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN copies c ON c.s = s.s
LEFT JOIN roots r ON r.x = c.rep LEFT JOIN linked l ON l.x = c.rep""",
    "op4_decontamination": rf"""WITH items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_PLAIN} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, len(w) AS size, array_to_string(w, ' ') AS g FROM items WHERE len(w) BETWEEN 1 AND 12
  UNION SELECT item, 13, unnest([array_to_string(w[i : i + 12], ' ') FOR i IN range(1, len(w) - 11)])
  FROM items WHERE len(w) >= 13),
worded AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
runs AS (
  SELECT doc_id, size, unnest([{{'place': i, 'g': array_to_string(w[i : i + size - 1], ' ')}}
    FOR i IN range(1, len(w) - size + 2)], recursive := true)
  FROM worded, (SELECT DISTINCT size FROM windows)),
found AS (SELECT r.doc_id, r.place, r.size, v.item FROM runs r JOIN windows v ON v.g = r.g AND v.size = r.size),
hit AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(place, place + size)) AS word FROM found)
  GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit,
  coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= coalesce(len(w), 0) AS contaminated
FROM worded LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)""",
    "op6_secrets": _secrets_sql(),
    "op9_warc": """WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS p FROM pages),
digests AS (
  SELECT page_id, octet_length(encode(p)) AS n, sha1(p) AS hex FROM payloads),
coded AS (
  SELECT page_id, n, hex, array_to_string([array_to_string(
      [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * g + 1, 5))::INT >> (15 - 5 * k)) & 31), 1)
       FOR k IN range(4)], '') FOR g IN range(8)], '') AS digest FROM digests),
ranked AS (
  SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS first
  FROM coded WINDOW w AS (PARTITION BY digest, n ORDER BY page_id))
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first END AS refers_to FROM ranked""",
    "op11_ranked_search": rf"""WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, {_PLAIN} AS w FROM documents),
held AS (SELECT * FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM held),
asked AS (
  SELECT k, item_id, term, count(*) AS c
  FROM (SELECT k, item_id, unnest(w) AS term
        FROM (SELECT row_number() OVER () AS k, item_id, {_PLAIN} AS w FROM benchmark))
  GROUP BY k, item_id, term),
uses AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM held)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM uses, totals GROUP BY term),
sized AS (SELECT r, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM held, totals),
scored AS (
  SELECT k, item_id, doc_id, sum(c * v.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked a JOIN uses u USING (term) JOIN weights v USING (term) JOIN sized s USING (r)
  GROUP BY k, item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_periodic_runs": r"""WITH worded AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
coded AS (
  SELECT *, len(w) AS n, xor(list_reduce(
    list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
    lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))),
    4294967295::BIGINT) AS h FROM worded),
cut AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 3 + (h // 10) % 8 AS d FROM coded),
texts AS (
  SELECT doc_id, r, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END] FOR i IN range(n)] ELSE w END AS w
  FROM cut),
tokens AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM texts),
equal AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM tokens x JOIN tokens y ON x.r = y.r AND x.word = y.word
    AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT r, q, min(i) AS s, count(*) + q AS len FROM (
    SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal)
  GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretches t WHERE NOT EXISTS (SELECT 1 FROM stretches o
    WHERE o.r = t.r AND o.q < t.q AND o.s <= t.s AND o.s + o.len >= t.s + t.len)),
described AS (
  SELECT r, count(*) AS n_runs, arg_min(struct_pack(s, len, q), (-len, s, q)) AS most,
    string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
left_over AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM tokens t WHERE NOT EXISTS (
    SELECT 1 FROM runs u WHERE u.r = t.r AND t.i >= u.s + u.q AND t.i < u.s + u.len) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, most.s::BIGINT AS start,
  most.len::BIGINT AS length, most.q::BIGINT AS period, (1000 * most.len // most.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts LEFT JOIN described USING (r) LEFT JOIN left_over USING (r)""",
}
