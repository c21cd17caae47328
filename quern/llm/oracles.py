"""SQL for the queries that SQL can express, for an engine that reads the same tables."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
WHITE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "op7_line_runs": f"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, f.key IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op9_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents)),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
    FROM (SELECT doc_id, list(word ORDER BY i) AS w FROM dw GROUP BY doc_id), sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, d.n, item_id FROM dwin d JOIN bwin b ON d.win = b.win AND d.n = b.n),
words AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM (SELECT doc_id, s, unnest(range(0, n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l GROUP BY doc_id),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN dl USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
       OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM b"""
ORACLES["op8_quality_cascade"] = _BASE.replace("\\\\", "\\")

ORACLES["op4_rlz_substrings"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
n AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k
      FROM (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d))),
gone AS (SELECT DISTINCT doc_id, s + j AS i FROM (SELECT doc_id, s, unnest(range(0, 20)) AS j FROM n WHERE k > 1)),
w AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d)),
m AS (SELECT w.doc_id, count(*) AS n_words, count(gone.i) AS n_removed,
             string_agg(word, ' ' ORDER BY w.i) FILTER (gone.i IS NULL) AS kept
      FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id)"""

#: Class links within equal shingle sets are added apart, so that copies make no pairs.
ORACLES["op1_minhash"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n"""

ORACLES["op11_filter_audit"] = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS fails FROM d),
q AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN q USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, i, o[i] AS own, o[1:i - 1] AS before FROM (SELECT o, unnest(range(1, 6)) AS i FROM o)),
r AS (
  SELECT part, o AS filter_order, i AS step, own, n, good, toxic, fails,
    contains(fails, own) AS bad, i > 1 AND translate(fails, before, '') <> fails AS earlier FROM c, s),
g AS (
  SELECT part, filter_order, step::INT AS step, any_value(own) AS own,
    coalesce(sum(n) FILTER (NOT bad AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bad AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (bad AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g"""


def _lloyd(rounds: int) -> str:
    """Codebooks by round: b0 the first parts, b1 and so on after each round."""
    nearest = "(SELECT p.*, min((list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - e[i]) * (part[i] - e[i])))::BIGINT, j)) AS best FROM p JOIN b{0} USING (pos) GROUP BY ALL)"
    out = ""
    for k in range(rounds):
        out += f"""
a{k} AS {nearest.format(k)},
m{k} AS (SELECT pos, j, list(v ORDER BY i) AS e FROM (
  SELECT pos, best[2] AS j, i, floor(sum(part[i])::DOUBLE / count(*))::BIGINT AS v FROM (SELECT pos, best, part, unnest(range(1, len(part) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY pos, j),
b{k + 1} AS (SELECT b{k}.pos, b{k}.j, coalesce(m{k}.e, b{k}.e) AS e FROM b{k} LEFT JOIN m{k} USING (pos, j)),"""
    return out + f"\na{rounds} AS {nearest.format(rounds)}"


ORACLES["op12_vector_codes"] = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, pos, x[pos * len(x) // 16 + 1:(pos + 1) * len(x) // 16] AS part FROM (SELECT *, unnest(range(0, 16)) AS pos FROM v)),
b0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS j, part AS e FROM p QUALIFY j < 64),{_lloyd(2)},
r AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY pos) AS code, sum(best[1])::BIGINT AS error FROM a2 GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY pos, j)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h"""
