"""SQL twins of the queries that SQL can express, for DuckDB."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Every statement reads documents by row: an id may be null or repeated.
_QUALITY_RULES = rf"""
WITH rows AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
positions AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM rows),
runs AS (
    SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS run
    FROM positions WINDOW o AS (PARTITION BY r ORDER BY i)),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs WHERE run IS NOT NULL),
repeated AS (
    SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM windows WHERE n > 1) GROUP BY r),
lines AS (
    SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
    SELECT r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM rows LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)),
failed AS MATERIALIZED (
    SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)::BIGINT AS base, (n_symbols > 0.1::DOUBLE * n_words)::BIGINT AS symbols,
        (n_dup_lines > 0.05::DOUBLE * n_words)::BIGINT AS lines,
        (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words))::BIGINT AS word_length FROM measured),
sums AS (UNPIVOT failed ON base, symbols, lines, word_length INTO NAME rule VALUE f),
hosts AS MATERIALIZED (
    SELECT rule, source, count(*)::DOUBLE AS n, sum(f)::DOUBLE AS f FROM sums WHERE source IS NOT NULL GROUP BY rule, source),
moments AS (
    SELECT rule, sum(f) / sum(n) AS mean, count(*) - 1.0 AS k, sum(n) AS total, sum(n * n) AS squares,
        sum(f * f / n) - sum(f) * sum(f) / sum(n) AS spread FROM hosts GROUP BY rule),
priors AS (
    SELECT rule, mean, CASE WHEN mean * (1 - mean) * (total - squares / total - k) > 0 THEN
        least(greatest((spread - mean * (1 - mean) * k) / (mean * (1 - mean) * (total - squares / total - k)), 0), 1) ELSE 0 END AS rho
    FROM moments),
rates AS (
    SELECT source, rule, (f * rho + (1 - rho) * mean) / (n * rho + 1 - rho) AS rate FROM hosts JOIN priors USING (rule)),
verdicts AS MATERIALIZED (
    SELECT source, max(rate) > 0.5 AS rejected, max(rate) FILTER (rule = 'base') AS rate_base, max(rate) FILTER (rule = 'symbols') AS rate_symbols,
        max(rate) FILTER (rule = 'lines') AS rate_lines, max(rate) FILTER (rule = 'word_length') AS rate_word_length
    FROM rates GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base = 1 AS base_failed, coalesce(rejected, false) AS host_rejected,
    base = 0 AND NOT coalesce(rejected, false) AS kept, round(rate_base, 9) AS rate_base, round(rate_symbols, 9) AS rate_symbols,
    round(rate_lines, 9) AS rate_lines, round(rate_word_length, 9) AS rate_word_length
FROM failed LEFT JOIN verdicts USING (source)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = "(1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + {size}))"
_F = "((({p}) - ({q})) * (({p}) - ({q})) // ({q}))"

# Every group gets every kept term of its language; the sums are plain ones over all of them.
_SOURCE_DIVERGENCE = rf"""
WITH rows AS MATERIALIZED (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
found AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM rows),
kept AS MATERIALIZED (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS size FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM rows),
p AS MATERIALIZED (
    SELECT lang, source, term, coalesce(n, 0) AS n, {_P.format(n="coalesce(n, 0)", total="coalesce(total, 0)", size="size")} AS p
    FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
whole AS (
    SELECT lang, term, {_P.format(n="n", total="total", size="size")} AS q FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term)
    JOIN (SELECT lang, sum(n) AS total FROM counts GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
pair AS (
    SELECT a.lang, a.source, b.source AS item, sum({_F.format(p="a.p", q="b.p")}) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
tells AS (
    SELECT lang, source, term AS item, {_F.format(p="p", q="q")}::BIGINT AS value FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item)::INT AS rank
    FROM (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM tells))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

# CRC-32 of a decimal id, bit by bit; nodes are the distinct lists of turns themselves.
_CRC32 = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT),"
    " lambda crc, byte: list_reduce([xor(crc, byte)] || range(8),"
    " lambda bits, i: CASE WHEN bits % 2 = 1 THEN xor(bits // 2, 3988292384::BIGINT) ELSE bits // 2 END)), 4294967295::BIGINT)"
)
_CONVERSATION_TRIE = f"""
WITH originals AS MATERIALIZED (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
    GROUP BY conv_id),
heads AS (SELECT conv_id, turns, conv_id - conv_id % 5 AS lender, {_CRC32} % 9 AS h FROM originals),
rebuilt AS MATERIALIZED (
    SELECT a.conv_id, coalesce(b.turns[1:h], a.turns[1:0]) || a.turns[h + 1:] AS turns FROM heads a LEFT JOIN originals b ON b.conv_id = lender),
prefixes AS MATERIALIZED (
    SELECT conv_id, depth, turns[1:depth] AS prefix, depth = len(turns) AS is_end
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)),
nodes AS MATERIALIZED (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
    FROM prefixes GROUP BY prefix, depth),
counted AS MATERIALIZED (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN (
        SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1) c USING (prefix)),
above AS (SELECT *, unnest(range(depth + 1)) AS d FROM counted),
subtrees AS (
    SELECT prefix[1:d] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves,
        sum((n_convs - 1) * CASE WHEN depth > 0 THEN strlen(prefix[depth].text) ELSE 0 END)::BIGINT AS saved_tokens
    FROM above GROUP BY prefix[1:d])
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s ON s.prefix = c.prefix LEFT JOIN nodes p ON c.depth > 0 AND p.prefix = c.prefix[1:c.depth - 1]
"""

ORACLES = {
    "op12_conversation_trie": _CONVERSATION_TRIE,
    "op11_source_divergence": _SOURCE_DIVERGENCE,
    "op13_quality_rules": _QUALITY_RULES,
}
