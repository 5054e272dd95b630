"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

import re

from .language import TOP
from .mixing import HOLDS, MOST, ROUNDS
from .quality_rules import POLICIES, RULES
from .secrets import ADDED, BASE

_WORD = r"[^\x20\x09-\x0D]+"

_bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))


def _any(policy: str) -> str:
    return "(" + " OR ".join(f"({RULES[r]})" for r in POLICIES[policy]) + ")"


OP7 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
again AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY r),
lines AS (SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}') GROUP BY r, l),
dups AS (SELECT r, sum(n - 1) AS dup, sum(n) AS n FROM lines GROUP BY r),
m AS (
  SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    coalesce(again.n, 0) AS n_repeat_words, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_lines,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN again USING (r) LEFT JOIN dups USING (r))
"""
VERDICTS = f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_any("base")} AS base_failed,
  NOT {_any("base")} AND NOT {_any("v1")} AS kept, CAST({_bits} AS BIGINT) AS failure_bits
FROM m
"""
VERSIONS = " UNION ALL ".join(f"SELECT '{p}' AS policy, count(*) AS documents, count(*) FILTER (NOT {_any(p)}) AS kept, count(*) FILTER ({_any(p)} <> {_any('base')}) AS unlike_base FROM m" for p in POLICIES)
_N_FAILED = " + ".join(f"CAST(({rule}) AS INT)" for rule in RULES.values())
ABLATION = " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER ({_any('v2')}) AS rejected, count(*) FILTER ({RULES[r]}) AS failed, count(*) FILTER (({RULES[r]}) AND {_N_FAILED} = 1) AS alone FROM m" for r in POLICIES["v2"])

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (SELECT r, i, md5(array_to_string(ws[i:i+34], ' ')) AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + o AS p FROM windows JOIN twice USING (s), (SELECT unnest(range(0, 35)) AS o)),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
kept AS (
  SELECT r, count(gone.p) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS t
  FROM words LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents),
sh AS (
  SELECT DISTINCT r, array_to_string(ws[i:i+2], ' ') AS s
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n, md5(string_agg(s, '/' ORDER BY s)) AS mark FROM sh GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.r <> b.r GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, y FROM reach JOIN link ON t = x),
least AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = t GROUP BY reach.r),
class AS (SELECT mark, min(doc_id) AS class_id FROM n JOIN d USING (r) GROUP BY mark),
links AS (SELECT x AS r, count(*) AS n_links FROM link GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM d JOIN least USING (r) LEFT JOIN n USING (r) LEFT JOIN class USING (mark) LEFT JOIN links USING (r)
"""


def _op2(rounds: int, topic: str, targets: dict, seed: int = 0) -> str:
    steps, last = [], "c0"
    for i in range(rounds):
        for name in targets:
            new = f"w{i}_{name}"
            steps.append(f"{new} AS (SELECT * REPLACE (CASE WHEN share > 0 THEN share * t_{name} / sum(share) OVER (PARTITION BY {name}) ELSE 0.0 END AS share) FROM {last})")
            last = new
    goals = []
    for name, target in targets.items():
        raw = "CASE " + " ".join(f"WHEN {name} = '{v}' THEN CAST({x} AS DOUBLE)" for v, x in target.items()) + " ELSE 0.0 END" if isinstance(target, dict) else f"pow(CAST(m AS DOUBLE), {target})"
        goals.append(f"h0_{name} AS (SELECT {name}, raw / sum(raw) OVER () AS asked, m / CAST(sum(m) OVER () AS DOUBLE) * {MOST} AS bound, CAST(1 AS DOUBLE) AS scale FROM (SELECT {name}, {raw} AS raw, m FROM (SELECT {name}, sum(tokens) AS m FROM cells GROUP BY {name}) WHERE m > 0))")
        for i in range(HOLDS):
            free = "sum(CASE WHEN asked * scale <= bound THEN asked ELSE 0.0 END) OVER ()"
            cut = "sum(CASE WHEN asked * scale > bound THEN bound ELSE 0.0 END) OVER ()"
            goals.append(f"h{i + 1}_{name} AS (SELECT * REPLACE (CASE WHEN {free} > 0 THEN (1 - {cut}) / {free} ELSE scale END AS scale) FROM h{i}_{name})")
        goals.append(f"g_{name} AS (SELECT {name}, least(asked * scale, bound) AS t_{name} FROM h{HOLDS}_{name})")
    names = ", ".join(targets)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce({topic}, '(none)') AS topic,
    CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS n_tokens FROM documents),
cells AS (SELECT {names}, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY {names}),
{", ".join(goals)},
c0 AS (
  SELECT {names}, tokens, {", ".join(f"coalesce(t_{n}, 0.0) AS t_{n}" for n in targets)}, tokens / CAST(sum(tokens) OVER () AS DOUBLE) AS actual, tokens / CAST(sum(tokens) OVER () AS DOUBLE) AS share
  FROM cells {" ".join(f"LEFT JOIN g_{n} USING ({n})" for n in targets)}),
{", ".join(steps)},
r AS (SELECT {names}, CASE WHEN tokens > 0 THEN share * CAST(sum(tokens) OVER () AS DOUBLE) / tokens ELSE 0.0 END AS ratio FROM {last}),
p AS (SELECT {names}, CASE WHEN max(ratio) OVER () > 0 THEN round(ratio / max(ratio) OVER (), 9) ELSE 0.0 END AS probability FROM r)
SELECT doc_id, {names}, n_tokens, probability,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '(none)') || ':{seed}'), 1, 13) AS BIGINT) / CAST({16**13} AS DOUBLE) < probability AS sampled
FROM d JOIN p USING ({names})
"""


def _op3(top: int) -> str:
    return rf"""
WITH RECURSIVE bits(n, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS r, doc_id, lang,
    ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS s,
    coalesce(xor(list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0, false) AS held_out
  FROM documents, crc),
places AS (SELECT r, s, unnest(range(1, length(s) + 1)) AS i FROM d WHERE regexp_matches(s, '\p{{L}}')),
grams AS (
  SELECT r, substr(s, i, 1) AS g FROM places WHERE substr(s, i, 1) <> ' '
  UNION ALL SELECT r, substr(s, i, 2) FROM places WHERE i < length(s)
  UNION ALL SELECT r, substr(s, i, 3) FROM places WHERE i < length(s) - 1 AND substr(s, i + 1, 1) <> ' '),
counts AS (SELECT r, g, count(*) AS c FROM grams GROUP BY r, g),
own AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY c DESC, g) AS k FROM counts QUALIFY k <= {top}),
learned AS (SELECT lang, g, sum(c) AS c FROM counts JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g),
profile AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY c DESC, g) AS k FROM learned QUALIFY k <= {top}),
away AS (
  SELECT r, l.lang, sum(CASE WHEN p.k IS NULL THEN {top} ELSE abs(p.k - own.k) END) AS far, count(*) AS m
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = own.g GROUP BY r, l.lang),
best AS (SELECT r, lang, 1.0 - CAST(far AS DOUBLE) / (m * {top}) AS score FROM away QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0.0) AS score FROM d LEFT JOIN best USING (r)
"""


def _op8(rules: list[tuple[str, str, bool, str]], base: int) -> str:
    """rules: kind, pattern, whether in either case, condition on the match m."""
    parts = []
    for k, (kind, pattern, fold, condition) in enumerate(rules):
        quoted = ("(?i)" if fold else "") + pattern.replace("'", "''")
        parts.append(rf"""
SELECT r, {k} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT r, ms[i] AS m, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT r, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(text, '{quoted}') AS ms, regexp_split_to_array(text, '{quoted}') AS ps FROM d WHERE regexp_matches(text, '{quoted}'))))
WHERE {condition.replace("PATTERN", quoted)}""")
    said = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"CAST(coalesce(n_{rules[k][0]}, 0) AS BIGINT) AS n_{rules[k][0]}" for k in range(base))
    sums = ", ".join(f"count(*) FILTER (k = {k}) AS n_{rules[k][0]}" for k in range(base))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
a AS (SELECT r, {sums}, {said} FILTER (k < {base}) AS b, {said} AS spans FROM found GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""


OP11 = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT id, label, v FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY label, v) = 1),
scores AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CASE WHEN len(a.v) = 0 THEN 0 ELSE CAST(list_inner_product(a.v, b.v) AS BIGINT) END AS s
  FROM rows a JOIN rows b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
positive AS (SELECT a, b, s FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positive p JOIN scores n ON n.a = p.a AND NOT n.same AND 30 * CAST(p.s AS HUGEINT) <= 100 * CAST(n.s AS HUGEINT) AND 100 * CAST(n.s AS HUGEINT) <= 90 * CAST(p.s AS HUGEINT)
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 10
"""


OP13 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (
  SELECT lang, array_to_string(ws[i:i+m-1], ' ') AS p, m, count(*) AS f
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest(range(1, 5)) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, p, m, f AS a, string_split(p, ' ') AS ws FROM g WHERE m > 1 AND f >= 30),
cuts AS (SELECT lang, p, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k+1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.p, a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.p = cuts.x JOIN g y ON y.lang = cuts.lang AND y.p = cuts.y
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.p ORDER BY CAST(2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS BIGINT), k) = 1),
around AS (
  SELECT lang, array_to_string(ws[i:i+s-1], ' ') AS p, max(a) AS most
  FROM (SELECT *, unnest(range(1, m)) AS i FROM c), (SELECT unnest(range(2, 4)) AS s) WHERE s < m AND i + s - 1 <= m GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM scored LEFT JOIN around USING (lang, p) JOIN total USING (lang) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) <= 2000
"""


def sql(topic: str, targets: dict) -> dict[str, str]:
    """The SQL of every query that has one."""
    length = {"assign": "length(regexp_extract(m, 'PATTERN', 2)) >= 6", "access": "length(m) >= 20"}
    rules = [(r.kind, r.pattern, bool(r.flags & re.IGNORECASE), length.get(r.kind, "true")) for r in BASE + ADDED]
    return {
        "op2_source_mixing": _op2(ROUNDS, topic, targets),
        "op3_language_id": _op3(TOP),
        "op4_ngram_jaccard_join": OP4,
        "op7_quality_rules": OP7 + VERDICTS,
        "quality_rules_versions": OP7 + VERSIONS,
        "quality_rules_ablation": OP7 + ABLATION,
        "op8_secret_scan": _op8(rules, len(BASE)),
        "op10_substring_dedup": OP10,
        "op11_hard_negatives": OP11,
        "op13_collocations": OP13,
    }
