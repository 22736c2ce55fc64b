"""DuckDB SQL with the same rows as queries of this subpackage."""

from __future__ import annotations

from tablehaul.llm import hosts, quality, vector_codes
from tablehaul.llm.columns import ASCII_LOWER, ASCII_UPPER

_BITS = "\n      + ".join(f"(CASE WHEN {sql} THEN {quality.bit(rule)} ELSE 0 END)" for rule, sql in quality.RULES.items())

RULE_LEDGER = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
    windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
    m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN covered USING (r)),
    b AS (SELECT *, {_BITS} AS bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & {quality.BASE.mask}) <> 0 AS base_failed,
      (bits & {quality.DEFAULT.mask}) = 0 AS kept, n_lines, bits FROM b"""

_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in hosts.RULES)


def _levels(host: str) -> str:
    """Suffix and domain of a host as two columns; the default suffixes have two labels at most."""
    bare = f"regexp_replace(regexp_replace({host}, '^.*@', ''), ':[0-9]*$', '')"
    last = lambda n: f"array_to_string(string_split({bare}, '.')[-{n}:], '.')"
    address, long = rf"regexp_matches({bare}, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$|^\[')", f"{last(2)} IN ({', '.join(repr(x) for x in hosts.SUFFIXES)})"
    return (
        f"CASE WHEN {address} THEN '#' WHEN {long} THEN {last(2)} ELSE {last(1)} END AS suffix, "
        f"CASE WHEN {address} THEN {bare} WHEN {long} THEN {last(3)} ELSE {last(2)} END AS domain"
    )


def _weight(members: str, group: str, fallback: float) -> str:
    return f"""(SELECT CASE WHEN a IS NULL OR c - b <= 1e-9 THEN {fallback} WHEN a <= b THEN {hosts.MOST_WEIGHT}
        ELSE least(greatest((c - b) / (a - b) - 1, {hosts.LEAST_WEIGHT}), {hosts.MOST_WEIGHT}) END::double AS weight
      FROM (SELECT sum(shares - bad * bad / n) AS a, sum(bad / n * (1 - bad / n) * (k - 1)) AS b, sum(bad / n * (1 - bad / n) * (n - squares / n)) AS c
        FROM (SELECT count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS squares, sum(bad * bad / n) AS shares FROM {members} {group})))"""


def _effective(weight: str) -> str:
    size = f"n / (1 + (n - 1) / ({weight} + 1))"
    return f"{size} AS n, bad / n * ({size}) AS bad"


HOST_REPUTATION = rf"""WITH cut AS (SELECT page_id, contains(url, '://') AS has, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
    p AS (SELECT page_id, CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), '{ASCII_UPPER}', '{ASCII_LOWER}') ELSE '' END AS host,
      CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM cut),
    o AS (SELECT host, greatest(1 - quality, toxic) AS bad FROM p JOIN labels l ON l.doc_id = try_cast(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})([^0-9]|$)', 1) AS bigint)),
    h AS (SELECT host, count(*)::double AS n, sum(bad)::double AS bad, {_levels("host")} FROM o WHERE bad IS NOT NULL GROUP BY host),
    wh AS {_weight("h", "GROUP BY suffix, domain", hosts.LEVEL_WEIGHT)},
    dn AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM (SELECT suffix, domain, {_effective("weight")} FROM h, wh) GROUP BY suffix, domain),
    wd AS {_weight("dn", "GROUP BY suffix", hosts.STRANGERS)},
    s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM (SELECT suffix, {_effective("weight")} FROM dn, wd) GROUP BY suffix),
    ws AS {_weight("s", "", hosts.PRIOR_WEIGHT)},
    top AS (SELECT (coalesce(sum(bad), 0) + {hosts.PRIOR_BAD * hosts.PRIOR_WEIGHT}::double) / (coalesce(sum(n), 0) + {hosts.PRIOR_WEIGHT}::double) AS mean
      FROM (SELECT {_effective("weight")} FROM s, ws)),
    known AS (SELECT host, {_levels("host")} FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
    a AS (SELECT k.*, coalesce(h.n, 0) AS n, coalesce(h.bad, 0) AS bad, coalesce(dn.n, 0) AS d_n, coalesce(dn.bad, 0) AS d_bad, wh.weight AS h_weight,
      (coalesce(s.bad, 0) + ws.weight * top.mean) / (coalesce(s.n, 0) + ws.weight) AS s_mean, 1 / (1 / wd.weight + 1 / (coalesce(s.n, 0) + ws.weight)) AS w_d
      FROM known k LEFT JOIN h ON h.host = k.host LEFT JOIN dn ON dn.suffix = k.suffix AND dn.domain = k.domain LEFT JOIN s ON s.suffix = k.suffix, wh, wd, ws, top),
    b AS (SELECT *, (d_bad + w_d * s_mean) / (d_n + w_d) AS d_mean, 1 / (1 / h_weight + 1 / (d_n + w_d)) AS w_h FROM a),
    m AS (SELECT host, n, n + w_h AS sure, (bad + w_h * d_mean) / (n + w_h) AS mean FROM b),
    rep AS (SELECT host, n::bigint AS n, mean - {hosts.Z} * sqrt(mean * (1 - mean) / (sure + 1)) AS lower FROM m),
    rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
    fit AS (SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict FROM p JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, rule_verdict DESC) = 1)
    SELECT p.page_id, p.host, p.path, rule, coalesce(rule_verdict, CASE WHEN lower > {hosts.MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
      coalesce(n, 0) AS n_labelled
    FROM p LEFT JOIN fit USING (page_id) LEFT JOIN rep ON rep.host = p.host"""

REVISITS = r"""WITH n AS (SELECT page_id, url, html, coalesce(page_id, 0) AS n, md5(coalesce(html, '')) AS md FROM pages),
    parts AS (SELECT *, regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS u FROM n),
    keyed AS (SELECT *, list_sort(list_filter(string_split(substr(u.query, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x),
        '^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)'))) AS params FROM parts),
    c AS (SELECT *, CASE WHEN contains(url, '://') THEN lower(u.scheme) || '://' || regexp_replace(regexp_replace(lower(u.host), '^.*@', ''), CASE lower(u.scheme) WHEN 'http' THEN ':(80)?$' WHEN 'https' THEN ':(443)?$' ELSE ':$' END, '')
        || CASE WHEN u.path = '' THEN '/' ELSE u.path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END ELSE url END AS key,
      1704067200 + n * 60 AS tm, 1704067200 + n * 60 + CASE WHEN n % 11 = 0 THEN -3600 ELSE 21600 + (n % 50) * 3600 END AS again,
      CASE WHEN n % 5 <> 0 AND n % 13 <> 0 AND n % 17 <> 0 THEN '"' || left(md, 12) || '"' END AS etag,
      CASE WHEN n % 13 <> 0 AND n % 17 <> 0 THEN '2023-12-31' END AS modified, CASE WHEN n % 17 <> 0 THEN md END AS digest FROM keyed),
    v AS (SELECT 'revisit-' || page_id AS record_id, key, again AS tm, CASE WHEN etag IS NULL THEN NULL WHEN n % 7 = 0 THEN '"changed"' ELSE 'W/' || etag END AS own_etag,
      modified AS own_modified, digest AS own_digest FROM c),
    r AS (SELECT 'response-' || page_id AS response, key, tm, etag, modified, digest, html FROM c),
    met AS (SELECT v.record_id, v.key AS url, v.tm, own_etag, own_modified, own_digest, r.response, r.tm AS r_at, r.etag, r.modified, r.digest, r.html
      FROM v ASOF LEFT JOIN r ON v.key = r.key AND v.tm > r.tm),
    checked AS (SELECT *, CASE WHEN response IS NULL THEN 'orphan'
      WHEN own_etag IS NOT NULL AND etag IS NOT NULL THEN CASE WHEN regexp_replace(own_etag, '^W/', '') = etag THEN 'resolved' ELSE 'mismatch' END
      WHEN own_modified IS NOT NULL AND modified IS NOT NULL THEN CASE WHEN own_modified = modified THEN 'resolved' ELSE 'mismatch' END
      WHEN own_digest IS NOT NULL AND digest IS NOT NULL THEN CASE WHEN own_digest = digest THEN 'resolved' ELSE 'mismatch' END
      ELSE 'unchecked' END AS outcome FROM met)
    SELECT record_id, url, tm AS "at", outcome, response AS refers_to, r_at AS refers_to_at, CASE WHEN ok THEN 200 END AS status,
      CASE WHEN ok THEN array_to_string(list_filter(['cache-control: max-age=600', 'content-type: text/html', 'etag: ' || coalesce(own_etag, etag),
        'last-modified: ' || modified], lambda x: x IS NOT NULL), chr(10)) END AS headers,
      CASE WHEN ok THEN sha256(html) END AS payload_sha256
    FROM (SELECT *, outcome IN ('resolved', 'unchecked') AS ok FROM checked)"""

_POLICIES = ", ".join(f"('{p.name}', {p.version}, {p.mask}, '{r}', {quality.bit(r)})" for p in (quality.BASE, quality.DEFAULT) for r in p.rules)

ABLATIONS = f"""WITH asked(policy, version, mask, rule, bit) AS (VALUES {_POLICIES}), ledger AS ({RULE_LEDGER})
    SELECT policy, version, rule, count(*) FILTER ((bits & bit) <> 0) AS failed, count(*) FILTER ((bits & mask) = bit) AS failed_alone,
      count(*) FILTER ((bits & mask) <> 0) AS rejected FROM asked, ledger GROUP BY ALL"""

# crc32 of the decimal id, bit by bit; 3988292384 is its polynomial
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

PREFIX_TRIE = rf"""WITH said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT c, turn, sha256(length(role) || ':' || role || text) AS k, len(list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '')) AS w FROM said),
    own AS (SELECT c, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(w ORDER BY turn NULLS FIRST, k) AS ws, {_CRC32} % 4 AS h FROM t GROUP BY c),
    rebuilt AS (SELECT a.c, coalesce(b.ks[1:a.h], []) || a.ks[a.h + 1:] AS ks, coalesce(b.ws[1:a.h], []) || a.ws[a.h + 1:] AS ws
      FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 20),
    m AS (SELECT c, d, array_to_string(ks[1:d], '') AS node, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ks) AS ends FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM rebuilt)),
    n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids FROM m GROUP BY node, d),
    kids AS (SELECT substr(node, 1, 64 * (d - 1)) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
    whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
    sums AS (SELECT above AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens
      FROM (SELECT *, substr(node, 1, 64 * unnest(range(0, d + 1))) AS above FROM whole) GROUP BY above)
    SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(w.ids) AS ends_sha256
    FROM whole w JOIN sums USING (node) LEFT JOIN n p ON w.d > 0 AND p.node = substr(w.node, 1, 64 * (w.d - 1))"""


def _vector_codes(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds written out one after the other: distances to all entries, and means of members."""
    distance = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, part, e, d, x FROM (SELECT p.vec_id, p.part, p.x, c.e, {distance} AS d FROM p JOIN c{r} c USING (part))
      QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, e) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT part, e, list(s ORDER BY i) AS x FROM
      (SELECT part, e, i, floor(sum(x[i])::double / count(*))::bigint AS s FROM (SELECT part, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY part, e, i) GROUP BY part, e) m USING (part, e))"""
            )
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::double * {vector_codes.SCALE})::bigint) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, part, q[part * len(q) // 4 + 1:(part + 1) * len(q) // 4] AS x FROM (SELECT vec_id, q, unnest(range(4)) AS part FROM v)),
    c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p
      WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {vector_codes.ENTRIES})),
    {", ".join(steps)},
    done AS (SELECT vec_id, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM a{rounds} GROUP BY vec_id),
    books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS digest FROM c{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, digest AS codebooks_sha256 FROM done JOIN v USING (vec_id), books"""


VECTOR_CODES = _vector_codes()
