"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_A = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: str, rank: int, regex: str) -> str:
    return f"SELECT doc_id, o, t, '{kind}' k, {rank} kr, regexp_extract_all(t, '{regex}') m, string_split_regex(t, '{regex}') g FROM d WHERE regexp_matches(t, '{regex}')"


# Where a match starts: the lengths of the gaps up to it and of the matches before it.
_SPANS = """raw AS ({found}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) i FROM raw),
s AS (SELECT doc_id, o, t, k, kr, m[i] v,
  (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT st FROM each)"""

SECRET_SCAN = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, coalesce('=' || source, 'null') o FROM documents),
{_SPANS.format(found=" UNION ALL ".join([_found("assign", 0, _A), _found("access", 1, "AKIA[A-Z0-9]+"), _found("hex", 2, "[0-9a-f]{24,}"), _found("opaque", 3, "[A-Za-z0-9+/_-]{20,}")]))},
x AS (SELECT doc_id, o, k, kr, v, st, st + length(v) en, CASE WHEN k = 'assign' THEN regexp_extract(v, '{_A}', 2) ELSE v END val FROM s),
base AS (SELECT * FROM x WHERE k = 'hex' OR (k = 'assign' AND length(val) >= 6) OR (k = 'access' AND length(v) >= 20)),
opaque AS (SELECT * FROM x WHERE k = 'opaque' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.st < x.en AND x.st < b.en)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
per AS (SELECT val, o, count(DISTINCT (o, doc_id)) n FROM every GROUP BY val, o),
ranked AS (SELECT *, row_number() OVER (PARTITION BY val ORDER BY n DESC, o DESC) r, sum(n) OVER (PARTITION BY val) k, count(*) OVER (PARTITION BY val) owners FROM per),
sizes AS (SELECT o, count(DISTINCT (o, doc_id))::DOUBLE size FROM every GROUP BY o),
main AS (SELECT val, n::DOUBLE n, k::DOUBLE k, owners, size, (SELECT sum(size) FROM sizes) total FROM ranked JOIN sizes USING (o) WHERE r = 1),
own AS (SELECT val FROM main
  WHERE (owners <= 2 OR (2 * n > k AND n * total > k * size AND (n * total - k * size) * (n * total - k * size) > 9 * k * size * (total - size)))
  AND (k <= 8 OR k * k <= size)),
live AS (SELECT * FROM every SEMI JOIN own USING (val)),
shown AS (SELECT * FROM base UNION ALL SELECT * FROM live WHERE k = 'opaque'),
b AS (SELECT doc_id, count(*) FILTER (k = 'assign') n_assign, count(*) FILTER (k = 'access') n_access, count(*) FILTER (k = 'hex') n_hex, string_agg(k || ':' || st || ':' || en, ',' ORDER BY st, kr) s FROM base GROUP BY doc_id),
w AS (SELECT doc_id, string_agg(k || ':' || st || ':' || en, ',' ORDER BY st, kr) s FROM shown GROUP BY doc_id),
l AS (SELECT doc_id, count(*) n FROM live GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(b.s, '')) base_sha256, coalesce(w.s, '') spans, coalesce(l.n, 0) n_live
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN l USING (doc_id)
"""

_SPACE = r"[\x20\x09-\x0D]+"
_SEED = "[\ue020-\ue07e]+"
_PRIVATE, _FAR = ("".join(chr(first + i) for i in range(0x20, 0x7F)) for first in (0xE000, 0xF700))
_EDGES = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _rounds(n: int) -> str:
    out = ["v0 AS (SELECT DISTINCT value, seed, seed::DOUBLE c FROM e)"]
    for i in range(n):
        out.append(f"p{i + 1} AS (SELECT pattern, sum(n * c) / (sum(n) + 1) score FROM e JOIN v{i} USING (value, seed) GROUP BY pattern)")
        out.append(f"v{i + 1} AS (SELECT value, seed, CASE WHEN seed = 1 THEN 1.0 ELSE (1 - exp(sum(ln(1 - score)))) * coalesce(any_value(weight), 0) END c FROM e JOIN p{i + 1} USING (pattern) LEFT JOIN wt USING (value) GROUP BY value, seed)")
    return ",\n".join(out)


PII = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, '' o FROM documents),
{_SPANS.format(found=" UNION ALL ".join([_found("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+"), _found("ip", 1, "[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)"), _found("card", 2, "[0-9]([ -]?[0-9])+"), _found("phone", 3, "[+][0-9][ ().0-9-]+[0-9]")]))},
x AS (SELECT doc_id, t, k, kr, v, st, st + length(v) en, regexp_replace(v, '[^0-9]', '', 'g') dg FROM s),
base AS (SELECT * FROM x WHERE k = 'email'
  OR (k = 'ip' AND list_bool_and(list_transform(string_split(v, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT) <= 255, false))))
  OR (k = 'card' AND length(dg) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(dg[length(dg) + 1 - i] AS INT) WHEN CAST(dg[length(dg) + 1 - i] AS INT) > 4 THEN 2 * CAST(dg[length(dg) + 1 - i] AS INT) - 9 ELSE 2 * CAST(dg[length(dg) + 1 - i] AS INT) END)) % 10 = 0)
  OR (k = 'phone' AND length(dg) BETWEEN 9 AND 15)),
chars AS (SELECT doc_id, t, unnest(range(length(t))) i FROM d WHERE doc_id IN (SELECT doc_id FROM base)),
covered AS (SELECT doc_id, unnest(range(st, en)) i FROM base),
inside AS (SELECT doc_id, i, substring(t, i + 1, 1) ch, (doc_id, i) IN (SELECT (doc_id, i) FROM covered) hid FROM chars),
marks AS (SELECT doc_id, string_agg(CASE WHEN hid THEN chr((57344 + unicode(ch))::INT) WHEN unicode(ch) BETWEEN 57376 AND 57470 THEN chr((5888 + unicode(ch))::INT) ELSE ch END, '' ORDER BY i) m FROM inside GROUP BY doc_id),
moved AS (SELECT doc_id, coalesce(m, CASE WHEN regexp_matches(t, '{_SEED}') THEN translate(t, '{_PRIVATE}', '{_FAR}') ELSE t END) m FROM d LEFT JOIN marks USING (doc_id)),
md AS (SELECT doc_id, trim(m, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) u, m FROM moved),
sp AS (SELECT doc_id, string_split_regex(u, '{_SPACE}') w, string_split_regex(regexp_replace(regexp_replace(lower(u), '{_SEED}', '@', 'g'), '[0-9]+', '0', 'g'), '{_SPACE}') f FROM md WHERE u <> ''),
wd AS (SELECT doc_id, unnest(range(len(w))) i, unnest(w) word, unnest(f) f FROM sp),
ne AS (SELECT doc_id, i, word, lag(f, 2) OVER q b2, lag(f) OVER q b1, lead(f) OVER q a1, lead(f, 2) OVER q a2 FROM wd WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
occ AS (SELECT doc_id, i, word, ['around', b1, a1] pattern FROM ne WHERE b1 IS NOT NULL AND a1 IS NOT NULL
  UNION ALL SELECT doc_id, i, word, ['before', b2, b1] FROM ne WHERE b2 IS NOT NULL AND b1 IS NOT NULL
  UNION ALL SELECT doc_id, i, word, ['after', a1, a2] FROM ne WHERE a1 IS NOT NULL AND a2 IS NOT NULL),
induced AS (SELECT pattern, count(DISTINCT regexp_extract(word, '{_SEED}')) seeds, count(*) n FROM occ WHERE regexp_matches(word, '{_SEED}') GROUP BY pattern HAVING count(DISTINCT regexp_extract(word, '{_SEED}')) >= 3),
kept AS (SELECT pattern FROM (SELECT pattern, count(*) al FROM occ SEMI JOIN induced USING (pattern) GROUP BY pattern) JOIN induced USING (pattern) WHERE n >= 0.2 * al),
fd AS (SELECT * FROM (SELECT doc_id, i, word, CASE WHEN regexp_matches(word, '{_SEED}') THEN regexp_extract(word, '{_SEED}') ELSE trim(word, '{_EDGES}') END AS value, regexp_matches(word, '{_SEED}')::INT seed, pattern FROM occ SEMI JOIN kept USING (pattern)) WHERE value <> ''),
bg AS (SELECT trim(word, '{_EDGES}') AS value, count(*) al FROM wd WHERE trim(word, '{_EDGES}') IN (SELECT value FROM fd WHERE seed = 0) GROUP BY 1),
wt AS (SELECT value, count(DISTINCT (doc_id, i)) / any_value(al) weight FROM fd JOIN bg USING (value) WHERE seed = 0 GROUP BY value),
e AS (SELECT pattern, value, seed, count(*) n FROM fd GROUP BY ALL),
{_rounds(3)},
hit AS (SELECT DISTINCT doc_id, i, word FROM fd WHERE seed = 0 AND pattern IN (SELECT pattern FROM p3 WHERE score >= 0.5) AND value IN (SELECT value FROM v3 WHERE c >= 0.5 AND seed = 0)),
wg AS (SELECT doc_id, regexp_extract_all(m, '[^\x20\x09-\x0D]+') w, string_split_regex(m, '[^\x20\x09-\x0D]+') g FROM md),
extra AS (SELECT doc_id, 'context' k, 4 kr, st, st + length(trim(word, '{_EDGES}')) en FROM (SELECT doc_id, word,
  (coalesce(list_sum(list_transform(g[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i], lambda x: length(x))), 0))::BIGINT + length(word) - length(ltrim(word, '{_EDGES}')) st FROM hit JOIN wg USING (doc_id))),
b AS (SELECT doc_id, count(*) FILTER (k = 'email') n_email, count(*) FILTER (k = 'ip') n_ip, count(*) FILTER (k = 'card') n_card, count(*) FILTER (k = 'phone') n_phone, string_agg(k || ':' || st || ':' || en, ',' ORDER BY kr, st) s FROM base GROUP BY doc_id),
w AS (SELECT doc_id, string_agg(k || ':' || st || ':' || en, ',' ORDER BY kr, st) s, count(*) FILTER (k = 'context') n FROM (SELECT doc_id, k, kr, st, en FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone, sha256(coalesce(b.s, '')) base_sha256, coalesce(w.s, '') spans, coalesce(w.n, 0) n_context
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN w USING (doc_id)
"""

#: All pairs that share a shingle, then reachability.
NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) sh
  FROM d),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e2.b, r.c FROM r JOIN e2 ON e2.a = r.doc),
m AS (SELECT doc, min(c) component_id FROM r GROUP BY doc)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.doc = d.doc_id
"""

#: Checksum of a byte string, bit by bit from its definition: x is its bytes, a list of integers.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, {x}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda s, i: xor(s >> 1, (s & 1) * 3988292384))), 4294967295)"


def _crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of the SQL expression ``text``."""
    digits = f"hex(encode({text}))"
    return _CRC32.format(x=f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || {digits}[2 * i + 1:2 * i + 2])::BIGINT)")


_LEAF = "sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || coalesce(strlen({text}) || ':' || {text}, '-'))"


def _levels(name: str, group: str, height: int) -> str:
    """Levels of a tree over {name}0 (group, i, d): each has run, the digests of a node's children."""
    out = []
    for k in range(1, height + 1):
        out.append(f"{name}{k} AS MATERIALIZED (SELECT {group}, i // 16 i, CASE WHEN any_value(n) > {16 ** (k - 1)} THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END d, string_agg(d, '' ORDER BY i) run, any_value(n) n FROM {name}{k - 1} GROUP BY {group}, i // 16)")
    return ",\n".join(out)


_HEIGHT, _TOP = 6, 4  # levels: up to 16 ** 6 rows of a source, 16 ** 4 sources


def _climb() -> str:
    """Siblings and the root that follows from the presented leaf, level by level."""
    out, last = [], "c0"
    for k in range(1, _HEIGHT + _TOP + 1):
        leaves = k <= _HEIGHT
        level = f"l{k}" if leaves else f"t{k - _HEIGHT}"
        size = 16 ** (k - 1 if leaves else k - 1 - _HEIGHT)
        at = "c.i" if leaves else "c.j"
        on = "l.s = c.s AND l.i = c.i // 16" if leaves else "l.i = c.j // 16"
        cut = f"substring(run, 1, 64 * ({at} % 16)::INT) || {{x}} || substring(run, 64 * ({at} % 16)::INT + 65)"
        out.append(f"c{k} AS MATERIALIZED (SELECT c.doc_id, c.s, {'c.i // 16 i, c.j' if leaves else 'c.i, c.j // 16 j'}, c.leaf, CASE WHEN l.n > {size} THEN c.proof || {cut.format(x=chr(39) * 2)} ELSE c.proof END proof, CASE WHEN l.n > {size} THEN sha256({cut.format(x='c.now')}) ELSE c.now END now FROM {last} c JOIN {level} l ON {on})")
        last = f"c{k}"
    return ",\n".join(out)


#: Ranks by a window, levels by grouping, proofs by joining level after level.
MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') s, {_LEAF.format(text="text")} leaf,
  CASE WHEN doc_id IS NOT NULL AND {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END touched FROM documents),
l0 AS MATERIALIZED (SELECT doc_id, s, touched, leaf AS d, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 i, count(*) OVER (PARTITION BY s) n FROM d),
{_levels("l", "s", _HEIGHT)},
t0 AS MATERIALIZED (SELECT s, 0 g, d, row_number() OVER (ORDER BY s) - 1 i, count(*) OVER () n FROM l{_HEIGHT}),
{_levels("t", "g", _TOP)},
c0 AS (SELECT l0.doc_id, l0.s, l0.i, t0.i j, l0.d leaf, '' proof, coalesce(touched, l0.d) now FROM l0 JOIN t0 USING (s)),
{_climb()}
SELECT doc_id, leaf, t0.d subroot, r.d AS root, sha256(proof) proof_sha256, now folded_root, now = r.d AS verified
FROM c{_HEIGHT + _TOP} c JOIN t0 USING (s) CROSS JOIN t{_TOP} r
"""


def _runs(table: str, key: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key} k, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM {table}"


_EACH = "SELECT k, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i]) || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) f FROM {t}"

#: Every feature spelt out and hashed; a global sort instead of a selection.
RESAMPLE = f"""
WITH dw AS MATERIALIZED ({_runs("documents", "doc_id")}), bw AS ({_runs("benchmark", "0")}),
de AS MATERIALIZED ({_EACH.format(t="dw")}), be AS MATERIALIZED ({_EACH.format(t="bw")}),
h AS MATERIALIZED (SELECT f, {_crc32("f")} % 10000 b FROM (SELECT f FROM de UNION SELECT f FROM be)),
db AS MATERIALIZED (SELECT k, b, count(*) c FROM de JOIN h USING (f) GROUP BY k, b),
s AS (SELECT b, sum(c) s FROM db GROUP BY b), t AS (SELECT b, count(*) t FROM be JOIN h USING (f) GROUP BY b),
g AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(c), 0) FROM db) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM be) + 10000))))::BIGINT gain FROM s LEFT JOIN t USING (b)),
w AS (SELECT k doc_id, sum(c)::BIGINT n_features, sum(c * gain)::BIGINT weight FROM db JOIN g USING (b) GROUP BY k),
x AS (SELECT k doc_id, len(w) n, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('42:' || k), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT score FROM dw LEFT JOIN w ON doc_id = k),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r, count(*) OVER () n FROM x WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * r.n // 100 THEN r END AS rank FROM x LEFT JOIN r USING (doc_id)
"""
