"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from reelmart.llm.queries import MIX_SEED

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

# The water level is found in closed form: with the sources in the order of cap per weight, the first
# place from which on no further source is clamped.
OP3 = f"""
WITH sized AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT source_size * 3.0::DOUBLE / weight AS ratio, row_number() OVER before AS n,
    coalesce(sum(source_size * 3.0::DOUBLE) OVER earlier, 0) AS filled,
    sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open
  FROM sources
  WINDOW before AS (ORDER BY source_size * 3.0::DOUBLE / weight, source),
    earlier AS (ORDER BY source_size * 3.0::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((t.total - filled) / open, n) AS level FROM filling, (SELECT sum(source_size)::DOUBLE AS total FROM sources) t
  WHERE (t.total - filled) / open <= ratio),
targets AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, level * weight) AS target FROM sources, level),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
placed AS (
  SELECT s.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before
  FROM sized s JOIN split t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND words_before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Base32: five hexadecimal digits make four of its letters.
OP1 = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS digest
  FROM pages),
parts AS (
  SELECT DISTINCT digest, g, ('0x' || digest[g * 5 + 1 : g * 5 + 5])::INT AS bits
  FROM hashed, range(8) AS t(g)),
letters AS (
  SELECT digest, string_agg(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(bits >> 15) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((bits >> 10) & 31) + 1]
    || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((bits >> 5) & 31) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(bits & 31) + 1],
    '' ORDER BY g) AS payload_digest
  FROM parts GROUP BY digest),
firsts AS (SELECT digest, min(page_id) AS first_page FROM hashed GROUP BY digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to
FROM hashed JOIN letters USING (digest) JOIN firsts USING (digest)
"""

_BENCHMARK_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, {_BENCHMARK_WORDS} AS w FROM benchmark WHERE len({_BENCHMARK_WORDS}) > 0),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS part
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items)),
docs AS (SELECT doc_id, coalesce({_BENCHMARK_WORDS}, []) AS w FROM documents),
hits AS (
  SELECT doc_id, item, i, d.n
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows)) d
  JOIN windows ON windows.n = d.n AND part = array_to_string(w[i : i + d.n - 1], ' ')),
covered AS (
  SELECT doc_id, count(DISTINCT place)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item)::BIGINT AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS listed
  FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

# All strings of 400 bytes by their digests, taken from blocks of 256 places each; texts are written in
# hexadecimal, two digits a byte.
OP6 = """
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS code, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
blocks AS (
  SELECT rid, start, substr(code, 2 * start + 1, 2 * 655) AS part, least(256, n_bytes - 399 - start) AS many
  FROM (SELECT rid, code, n_bytes, unnest(range(0, n_bytes - 399, 256)) AS start FROM texts WHERE n_bytes >= 400)),
places AS (
  SELECT rid, start + i AS pos, md5_number(substr(part, 2 * i + 1, 800)) AS string
  FROM (SELECT rid, start, part, unnest(range(many)) AS i FROM blocks)),
twice AS (SELECT rid, pos, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS before
  FROM places JOIN (SELECT string FROM places GROUP BY string HAVING count(*) > 1) USING (string)),
runs AS (
  SELECT rid, run, min(pos) AS low, max(pos) + 400 AS high
  FROM (SELECT rid, pos, sum(CASE WHEN pos - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY pos) AS run FROM twice)
  GROUP BY rid, run),
kept AS (
  SELECT rid, n_removed, n_spans, string_agg(code[2 * low + 1 : 2 * coalesce(high, n_bytes)], '' ORDER BY low) AS kept
  FROM (
    SELECT rid, coalesce(lag(high) OVER w, 0) AS low, r.low AS high FROM runs r WINDOW w AS (PARTITION BY rid ORDER BY r.low)
    UNION ALL SELECT rid, max(high), NULL FROM runs GROUP BY rid)
  JOIN texts USING (rid)
  JOIN (SELECT rid, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid) USING (rid)
  GROUP BY rid, n_removed, n_spans)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, code))) AS kept_sha256,
  n_bytes - coalesce(n_removed, 0)::BIGINT AS n_kept, n_removed IS NOT NULL AS has_repeats
FROM texts LEFT JOIN kept USING (rid)
"""

OP10 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS part
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.part = y.part AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * common >= 75 * (s.n + t.n - common)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reached.doc_id, b FROM reached JOIN steps ON a = other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""


# The checksum runs over the bytes with the table of the reversed polynomial; words are near that have equal
# text without the same place, or of which one is the other without a place.
OP12 = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([i] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY i) AS step FROM range(256) AS t(i)),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
runs AS (
  SELECT run, count(*)::BIGINT AS n, hex(coalesce(doc_id::VARCHAR, 'null') || ':' || run) AS code FROM found GROUP BY doc_id, run),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    [4294967295] || list_transform(range(0, length(code) // 2), lambda i: ('0x' || code[2 * i + 1 : 2 * i + 2])::BIGINT),
    lambda c, x: xor(step[(xor(c, x) & 255) + 1], c >> 8))) AS h
  FROM runs, steps),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
      ELSE run END AS word FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
shortened AS (
  SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT s.word, w.word AS other FROM shortened s JOIN words w ON s.rest = w.word
  UNION
  SELECT DISTINCT w.word, s.word FROM shortened s JOIN words w ON s.rest = w.word
  UNION
  SELECT DISTINCT s.word, t.word FROM shortened s JOIN shortened t ON s.i = t.i AND s.rest = t.rest AND s.word <> t.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS other, max(w.n) AS other_n
  FROM near JOIN words w ON w.word = other GROUP BY near.word),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form,
    CASE WHEN other_n >= 5 * n THEN other_n END::BIGINT AS form_n
  FROM words LEFT JOIN best USING (word)),
followed AS (
  SELECT word, word AS last FROM forms
  UNION ALL
  SELECT followed.word, form FROM followed JOIN forms ON forms.word = last WHERE form IS NOT NULL)
SELECT forms.word, form, last AS root, n, n_near, form_n
FROM forms JOIN followed ON followed.word = forms.word
WHERE last IN (SELECT word FROM forms WHERE form IS NULL)
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op1_warc": OP1,
        "op3_mixing": OP3,
        "op5_decontamination": OP5,
        "op6_substring_dedup": OP6,
        "op10_near_duplicates": OP10,
        "op12_spelling_variants": OP12,
    }
