"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

REPEATED_PASSAGES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), starts AS (
  SELECT r, s, md5(array_to_string(w[s + 1 : s + 35], ' ')) AS h
  FROM (SELECT r, w, unnest(range(0, len(w) - 34)) AS s FROM d WHERE len(w) >= 35)
), again AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, s FROM starts SEMI JOIN again USING (h)),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM hit),
words AS (SELECT r, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def url_filter(rules: dict[str, str], alpha: float, rounds: int, threshold: float) -> str:
    fits = []
    for rule in sorted(rules, key=len, reverse=True):
        host, _, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{rule}'")
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules.items()) + " END"
    host = "translate(regexp_extract({0}, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"p AS MATERIALIZED (SELECT page_id, html, coalesce({host.format('url')}, '') AS host,"
        " coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"j AS MATERIALIZED (SELECT *, CASE {' '.join(fits)} END AS rule FROM p)",
        "links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''),"
        " '(?i)(?:href|src)\\s*=\\s*[\"'']?((?:[a-z][a-z0-9+.-]*:)?//[^\"''\\s>]+)', 1)) AS u FROM j WHERE host <> '')",
        f"ends AS (SELECT src, {host.format('CASE WHEN starts_with(u, $$//$$) THEN $$http:$$ || u ELSE u END')} AS dst FROM links)",
        "e AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS weight FROM ends WHERE dst <> '' AND dst <> src GROUP BY ALL)",
        f"own AS (SELECT host, count(*) AS pages, count(*) FILTER ({verdict} = 'allow') AS t, count(*) FILTER ({verdict} = 'block') AS d"
        " FROM j WHERE host <> '' GROUP BY host)",
        "hosts AS MATERIALIZED (SELECT host, coalesce(pages, 0)::DOUBLE AS pages, coalesce(t, 0)::DOUBLE AS t, coalesce(d, 0)::DOUBLE AS d"
        " FROM own FULL JOIN (SELECT DISTINCT dst AS host FROM e) USING (host))",
    ]
    for kind, a, b in (("t", "src", "dst"), ("d", "dst", "src")):
        parts.append(
            f"{kind}_steps AS MATERIALIZED (SELECT {a} AS a, {b} AS b, weight / sum(weight) OVER (PARTITION BY {a}) AS share FROM e)"
        )
        parts.append(f"{kind}0 AS MATERIALIZED (SELECT host, {kind} AS mass, pages AS whole FROM hosts)")
        for i in range(rounds):
            stays = f"CASE WHEN h.host IN (SELECT a FROM {kind}_steps) THEN 0 ELSE 1 END"
            parts.append(
                f"{kind}{i + 1} AS MATERIALIZED (SELECT h.host, (1 - {alpha}) * h.{kind} + {alpha} * (coalesce(g.got, 0) + {stays} * m.mass) AS mass,"
                f" (1 - {alpha}) * h.pages + {alpha} * (coalesce(g.got_whole, 0) + {stays} * m.whole) AS whole FROM hosts h JOIN {kind}{i} m USING (host)"
                f" LEFT JOIN (SELECT b AS host, sum(mass * share) AS got, sum(whole * share) AS got_whole FROM {kind}{i} JOIN {kind}_steps ON host = a"
                f" GROUP BY b) g USING (host))"
            )
    parts.append(
        f"bad AS (SELECT t.host FROM t{rounds} t JOIN d{rounds} d USING (host) WHERE"
        " CASE WHEN d.whole > 0 THEN d.mass / d.whole ELSE 0 END - CASE WHEN t.whole > 0 THEN t.mass / t.whole ELSE 0 END"
        f" > {threshold} + 1e-9)"
    )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT page_id, host, path, rule, coalesce({verdict},"
        " CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j"
    )


EXACT_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_WORDS = r"""list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

PHRASES = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS t
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(0, greatest(len(w) - 12, 1))) AS s FROM items WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, lengths WHERE len(w) >= n)
),
hit AS MATERIALIZED (SELECT r, s, n, item_id FROM spots JOIN win USING (n, t)),
covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) FROM hit) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

# The table of the checksum follows from its polynomial; bytes come from the hexadecimal form of the text.
BYTE_SHARDS = """
WITH RECURSIVE steps(b, c, k) AS (
  SELECT range, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
sized AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(
             regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
  FROM sized
), dealt AS (SELECT *, least(7, before * 8 // total)::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY before, doc_id NULLS FIRST, text_crc32) - 1 AS slot, NULL::INT AS grown_shard
FROM dealt
"""

# Groups by the whole normalised text; of a group the longest original text, then the smallest id stays.
EXACT_DUPLICATES = r"""
WITH plain AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
    FROM documents
),
placed AS (
    SELECT doc_id, body,
        first_value(doc_id) OVER w AS keep_id,
        count(*) OVER (PARTITION BY body) AS group_size,
        row_number() OVER w = 1 AS kept
    FROM plain
    WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM placed
"""
