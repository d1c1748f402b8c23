"""DuckDB SQL with the same results as the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = r"""
WITH turns AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), put AS (
  SELECT *, regexp_replace(regexp_replace(text, '(<)(\\*/?s>)', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g') AS t,
    regexp_replace(regexp_replace(role, '(<)(\\*/?s>)', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g') AS r FROM turns
), one AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(r) + length(t) + length('<s>[INST][/INST]</s>')) AS n FROM put GROUP BY conv_id, own
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars, TRUE AS exact FROM one
"""

OP5 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM grams),
least AS (SELECT k, min(doc_id) AS d FROM g GROUP BY k),
hit AS (SELECT g.doc_id, g.i FROM g JOIN least USING (k) WHERE least.d < g.doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM hit),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP7 = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
tri AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM a)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS i FROM twice) GROUP BY doc_id),
b AS (SELECT a.doc_id, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, coalesce(cov.n, 0) AS n_repeat_words FROM a LEFT JOIN cov USING (doc_id)),
c AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM b),
d AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (5 * n_symbols > n_words)::INT
  + 8 * (word_chars < 3 * n_words OR word_chars > 12 * n_words)::INT + 16 * (2 * n_dup_lines > n_lines)::INT + 32 * (2 * n_upper > word_chars)::INT + 64 * (n_words = 0)::INT AS BIGINT) AS failed_bits FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed_bits % 4 <> 0 AS base_failed, failed_bits & 63 = 0 AS kept, failed_bits,
  failed_bits & 3 = 0 AS kept_base_1, failed_bits & 15 = 0 AS kept_prose_1, failed_bits & 63 = 0 AS kept_prose_2, failed_bits & 126 = 0 AS kept_corpus_1 FROM d
"""

#: Policies as (name, version, mask) and rules as (name, bit).
ABLATIONS = f"""
WITH led AS (SELECT failed_bits AS b FROM ({OP7})),
p(policy, version, mask) AS (VALUES ('base', 1, 3), ('prose', 1, 15), ('prose', 2, 63), ('corpus', 1, 126)),
r(rule, bit) AS (VALUES ('too_few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('word_length', 8), ('duplicate_lines', 16), ('shouting', 32), ('no_words', 64))
SELECT policy, version, rule, count(*) FILTER (b & mask = 0)::BIGINT AS n_kept, count(*) FILTER (b & mask & bit <> 0)::BIGINT AS n_failed,
  count(*) FILTER (b & mask = bit)::BIGINT AS n_failed_alone, count(*) FILTER (b & mask & ~bit = 0)::BIGINT AS n_kept_without
FROM led, p JOIN r ON mask & bit <> 0 GROUP BY policy, version, rule
"""


def _op1() -> str:
    """Mixing with the production weights: the same budgets, level by level, and the prefix by one running sum."""
    from glimmer.llm.mixing import PRODUCTION as mix

    weights = ", ".join(f"('{k}', {v})" for k, v in sorted(mix.weights.items()))
    domain = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{n}'" for n, p in mix.domains) + f" ELSE '{mix.other_domain}' END"
    ctes, given, parents = [], f"(SELECT (coalesce(sum(tokens), 0) * {mix.budget_permille} // 1000)::BIGINT FROM leaves)", ""
    for depth, path in enumerate((("domain",), ("domain", "lang"), ("domain", "lang", "source"))):
        p, key = ", ".join(path), " || '/' || ".join(path)
        up = ", ".join(path[:-1])
        over = f"PARTITION BY {up}" if up else ""
        source = f"JOIN b{depth - 1} USING ({up})" if up else ""
        ctes.append(f"""n{depth} AS (SELECT {p}, (CASE WHEN w > 0 THEN c ELSE 0 END)::BIGINT AS c, greatest(w, 1)::BIGINT AS w, g FROM
          (SELECT x.*, coalesce(weights.w, 1) AS w, {"b%d.b" % (depth - 1) if up else given} AS g FROM (SELECT {p}, sum(tokens * {mix.epochs}) AS c FROM leaves GROUP BY {p}) x {source} LEFT JOIN weights ON weights.k = {key})),
        o{depth} AS (SELECT *, least(g, sum(c) OVER ({over})) AS gg, coalesce(sum(c) OVER r, 0) AS c0, sum(w) OVER ({over}) - coalesce(sum(w) OVER r, 0) AS w0 FROM n{depth}
          WINDOW r AS ({over} ORDER BY c / w, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f{depth} AS (SELECT *, c * w0 <= (gg - c0) * w AS full_ FROM o{depth}),
        b{depth} AS (SELECT {p}, CASE WHEN full_ THEN c ELSE (gg - coalesce(sum(c) FILTER (full_) OVER ({over}), 0)) * w // sum(w) FILTER (NOT full_) OVER ({over}) END AS b FROM f{depth})""")
    return rf"""
WITH weights(k, w) AS (VALUES {weights}),
d0 AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
d AS (SELECT doc_id, {domain} AS domain, lang, s AS source, n_tokens FROM d0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{", ".join(ctes)},
plan AS (SELECT domain, lang, source, coalesce(b // nullif(tokens, 0), 0)::BIGINT AS whole, (b - coalesce(b // nullif(tokens, 0), 0) * tokens)::BIGINT AS rest FROM leaves JOIN b2 USING (domain, lang, source)),
placed AS (SELECT d.*, whole, rest, md5(concat_ws(':', '{mix.seed}', whole::VARCHAR, doc_id::VARCHAR)) AS place FROM d JOIN plan USING (domain, lang, source)),
upto AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS u FROM placed),
n AS (SELECT *, whole + (rest > 0 AND u <= rest)::INT AS n FROM upto)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, unnest(range(n))::BIGINT AS epoch FROM n WHERE n > 0
"""


OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op8() -> str:
    """License scan: base phrases by position, templates by votes, all from one table of words."""
    from glimmer.llm.licenses import BASE_PHRASES, PLAIN, TEMPLATES

    rows = []
    for t, x in enumerate(TEMPLATES):
        words, key = x.text.split(), x.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows += [f"({t}, {i}, '{w}', {w not in PLAIN}, {at <= i < at + len(key)})" for i, w in enumerate(words)]
    labels = ", ".join(f"({t}, '{x.label}', {len(x.key.split())})" for t, x in enumerate(TEMPLATES))
    base = " UNION ALL ".join(
        f"SELECT w0.doc_id, w0.p, '{label}' AS label FROM w w0 " + " ".join(f"JOIN w w{j} ON w{j}.doc_id = w0.doc_id AND w{j}.p = w0.p + {j} AND w{j}.x = '{x}'" for j, x in enumerate(phrase.split()) if j) + f" WHERE w0.x = '{phrase.split()[0]}'"
        for phrase, label in BASE_PHRASES
    )
    return rf"""
WITH post(t, i, x, rare, key) AS (VALUES {", ".join(rows)}), lab(t, label, n_keys) AS (VALUES {labels}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS p FROM d),
base AS ({base}),
n AS (SELECT count(*) AS n FROM documents), vocab AS (SELECT DISTINCT x FROM post WHERE rare),
df AS (SELECT vocab.x, count(DISTINCT doc_id) AS df FROM vocab LEFT JOIN w USING (x) GROUP BY ALL), idf AS (SELECT x, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM df, n),
total AS (SELECT t, sum(idf) AS total FROM post JOIN idf USING (x) GROUP BY ALL),
votes AS (SELECT w.doc_id, post.t, w.p - post.i AS start, count(*) FILTER (key) AS keys, coalesce(sum(idf.idf), 0) AS weight FROM w JOIN post USING (x) LEFT JOIN idf ON idf.x = w.x GROUP BY ALL),
met AS (SELECT doc_id, label, least(weight / total, 1) AS score FROM votes JOIN lab USING (t) JOIN total USING (t) WHERE keys = n_keys AND weight >= 0.5 * total - 1e-9),
b AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY ALL),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM met) GROUP BY ALL),
m AS (SELECT doc_id, max(score) AS score FROM met GROUP BY ALL)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(m.score, 0) END, 6)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)
"""


ORACLES = {"op1_source_mixing": _op1(), "op4_exact_top_k": OP4, "op3_chat_formatting": OP3, "op5_substring_dedup": OP5, "op7_quality_rules": OP7, "quality_ablations": ABLATIONS, "op8_license_scan": _op8()}
