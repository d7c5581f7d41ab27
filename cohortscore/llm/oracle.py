"""DuckDB SQL for the queries of this subpackage."""

OP2 = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP10 = r"""
WITH r(kind, site, start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, url,
        translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
        list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'),
          lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)'))) AS args
      FROM u),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(?:www|m)\.', ''), ':(?:80|443)$', '')
        || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '')
        || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS key FROM p),
listed AS (SELECT DISTINCT key FROM c WHERE key IS NOT NULL
           AND regexp_extract(url, '://(?:[a-z]+\.)?([a-z-]+)\.example\.', 1) IN ('ads-track', 'cheap-pills', 'casino-win', 'free-bets', 'spam-farm', 'adult-x')),
best AS (SELECT page_id, url, max_by(site || start, length(site || start)) AS rule, max_by(kind, length(site || start)) AS verdict
         FROM c JOIN r ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY 1, 2)
SELECT c.page_id, c.host, c.path, best.rule,
       coalesce(best.verdict, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       listed.key IS NOT NULL AS listed
FROM c LEFT JOIN best ON c.page_id = best.page_id AND c.url = best.url LEFT JOIN listed ON c.key = listed.key
"""



#: Shingles by joining rows of words; all pairs with a common shingle; components as the closure of the links.
OP5 = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM t),
v AS (SELECT doc_id, n, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS sh FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, sh FROM v WHERE sh IS NOT NULL UNION SELECT doc_id, array_to_string(ws, ' ') FROM t WHERE len(ws) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(t.doc_id, m.y), t.doc_id) AS component_id
FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY 1) m ON t.doc_id = m.x
"""

#: Windows as aggregates over the next 50 rows of words.
OP8 = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM t),
g AS (SELECT doc_id, i, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS p FROM u),
h AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY p) AS first FROM g WHERE i + 50 <= n),
c AS (SELECT DISTINCT doc_id, i + d AS i FROM h, range(50) AS r(d) WHERE first < doc_id),
k AS (SELECT u.doc_id, count(*) FILTER (c.i IS NOT NULL) AS gone, string_agg(u.w, ' ' ORDER BY u.i) FILTER (c.i IS NULL) AS kept FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY 1)
SELECT t.doc_id, len(ws)::bigint AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""


def op1() -> str:
    """Base counts over unnested windows and the robust estimates over single rows, with weights, by an LDL factor.

    Only the fixed parameters are the operator's; its distinct vectors, moments and formulas are not used."""
    from cohortscore.llm.quality import CUT, FEATURES, NEAR, NEAR_SCALE, PRIOR, STEPS, SUBSET, SUBSET_SCALE

    four, pairs = range(4), [(i, j) for i in range(4) for j in range(i + 1)]
    xs = ", ".join(f"cast(round(coalesce({sql}, 0)) as bigint) AS {c}" for c, sql, _ in FEATURES)
    each = lambda f: ", ".join(f(i) for i in four)
    both = lambda f: ", ".join(f(i, j) for i, j in pairs)
    sums = "sum(w) AS n, " + each(lambda i: f"sum(w * x{i}) AS s{i}") + ", " + both(lambda i, j: f"sum(w * x{i} * x{j}) AS q{i}{j}")
    ctes: list[str] = []

    def cte(name: str, sql: str) -> None:
        ctes.append(f"{name} AS MATERIALIZED ({sql})")

    def factor(name: str, source: str, on: str) -> None:
        """From v.. (covariances) the unit lower factor g.. and the pivots e.. with v = g e g'."""
        for j in four:
            cte(f"{name}{j}a", f"SELECT *, v{j}{j}" + "".join(f" - g{j}{k} * g{j}{k} * e{k}" for k in range(j)) + f" AS e{j} FROM {source}")
            below = ", ".join(f"(v{i}{j}" + "".join(f" - g{i}{k} * g{j}{k} * e{k}" for k in range(j)) + f") / e{j} AS g{i}{j}" for i in range(j + 1, 4))
            source = f"{name}{j}b"
            cte(source, f"SELECT *{', ' + below if below else ''} FROM {name}{j}a")
        cte(name, f"SELECT {on}, {each(lambda i: f'm{i}, e{i}')}, {', '.join(f'g{i}{j}' for i, j in pairs if i > j)}, ln(e0 * e1 * e2 * e3) AS logdet FROM {source}")

    def distance(name: str, rows: str, fit: str, join: str) -> None:
        source = f"(SELECT r.*, f.* EXCLUDE (k0, k1) FROM {rows} r {join} JOIN {fit} f ON r.k0 = f.k0 AND r.k1 = f.k1)"
        for i in four:
            cte(f"{name}{i}", f"SELECT *, x{i} - m{i}" + "".join(f" - g{i}{k} * t{k}" for k in range(i)) + f" AS t{i} FROM {source}")
            source = f"{name}{i}"
        cte(name, "SELECT *, " + " + ".join(f"t{i} * t{i} / e{i}" for i in four) + f" AS d2 FROM {source}")

    def fitted(name: str, source: str, pool: str, scale: float, on: str) -> None:
        """Moments of a group and of PRIOR rows of the pool: means, and covariances with the noise."""
        share = f"coalesce({PRIOR} / nullif((SELECT n FROM {pool}), 0), 0)"
        add = lambda c: f"{c} + {share} * coalesce((SELECT {c} FROM {pool}), 0) AS {c}"
        cte(f"{name}_n", f"SELECT {on}, {add('n')}, {each(lambda i: add(f's{i}'))}, {both(lambda i, j: add(f'q{i}{j}'))} FROM {source}")
        cte(f"{name}_m", f"SELECT *, {each(lambda i: f's{i} / n AS m{i}')} FROM {name}_n")
        noise = lambda i, j: f" + {FEATURES[i][2]} * {FEATURES[i][2]}" if i == j else ""
        cte(f"{name}_v", f"SELECT *, {both(lambda i, j: f'{scale} * (q{i}{j} / n - m{i} * m{j}){noise(i, j)} AS v{i}{j}')} FROM {name}_m")
        factor(name, f"{name}_v", on)

    cte("w", """SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS k0, coalesce(source, '') AS k1,
                 list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents""")
    cte("g", "SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3")
    cte("h", "SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n FROM g")
    cte("r", "SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM h, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY 1")
    cte("b", """SELECT doc_id, k0, k1, cast(len(words) as bigint) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, cast(len(lines) as bigint) AS n_lines,
                 cast(len(lines) - len(list_distinct(lines)) as bigint) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
               FROM w LEFT JOIN r USING (doc_id)""")
    cte("x", f"SELECT *, {xs}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b")
    cte("good", f"SELECT doc_id, k0, k1, {each(lambda i: f'x{i}')} FROM x WHERE NOT base_failed")
    # Starts: medians and MADs alone, and with the correlations of bent and of unit vectors.
    cte("med", f"SELECT k0, k1, {each(lambda i: f'median(x{i}) AS m{i}')} FROM good GROUP BY 1, 2")
    cte("mad", f"SELECT k0, k1, {each(lambda i: f'sqrt((1.4826 * median(abs(x{i} - m{i}))) ** 2 + {FEATURES[i][2]} ** 2) AS d{i}')} FROM good JOIN med USING (k0, k1) GROUP BY 1, 2")
    cte("zs", f"SELECT good.k0, good.k1, {each(lambda i: f'(x{i} - m{i}) / d{i} AS z{i}')} FROM good JOIN med USING (k0, k1) JOIN mad USING (k0, k1)")
    long = "greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in four) + "), 1e-9)"
    cte("ys", f"SELECT k0, k1, 1 AS start, {each(lambda i: f'round(1000 * tanh(z{i})) AS y{i}')} FROM zs UNION ALL SELECT k0, k1, 2, {each(lambda i: f'round(1000 * (z{i} / {long}))')} FROM zs")
    noisy = lambda i: f"(covar_pop(y{i}, y{i}) + 10000)"
    off = lambda i, j: "1" if i == j else f"covar_pop(y{i}, y{j}) / sqrt({noisy(i)} * {noisy(j)})"
    cte("cor", f"SELECT k0, k1, start, {both(lambda i, j: f'{off(i, j)} AS v{i}{j}')} FROM ys GROUP BY 1, 2, 3 UNION ALL SELECT k0, k1, 0, {both(lambda i, j: str(int(i == j)))} FROM med")
    cte("cov", f"SELECT k0, k1, start, {each(lambda i: f'm{i}')}, {both(lambda i, j: f'v{i}{j} * d{i} * d{j} AS v{i}{j}')} FROM cor JOIN med USING (k0, k1) JOIN mad USING (k0, k1)")
    factor("fit0", "cov", "k0, k1, start")
    for step in range(1, STEPS + 1):
        distance(f"near{step}", "good", f"fit{step - 1}", "")
        cte(f"rank{step}", f"SELECT *, cast(floor(64 * ln(greatest(d2, 0.0001)) / ln(2.0)) as int) AS bin FROM near{step}")
        cte(f"bin{step}", f"SELECT k0, k1, start, bin, count(*) AS many FROM rank{step} GROUP BY ALL")
        of = "PARTITION BY k0, k1, start"
        cte(f"share{step}", f"""SELECT k0, k1, start, bin, greatest(0, least(1, (ceil({SUBSET} * sum(many) OVER ({of})) - sum(many) OVER ({of} ORDER BY bin) + many) / many)) AS w FROM bin{step}""")
        cte(f"sum{step}", f"SELECT k0, k1, start, {sums} FROM rank{step} JOIN share{step} USING (k0, k1, start, bin) GROUP BY 1, 2, 3")
        if step == 1:
            cte("pool", f"SELECT sum(n) AS n, {each(lambda i: f'sum(s{i}) AS s{i}')}, {both(lambda i, j: f'sum(q{i}{j}) AS q{i}{j}')} FROM sum1 WHERE start = 0")
        fitted(f"fit{step}", f"sum{step}", "pool", SUBSET_SCALE, "k0, k1, start")
    cte("best", f"SELECT * EXCLUDE (start, place) FROM (SELECT *, row_number() OVER (PARTITION BY k0, k1 ORDER BY round(logdet, 9), start) AS place FROM fit{STEPS}) WHERE place = 1")
    distance("last", "good", "best", "")
    weighed = sums.replace("sum(w", "sum(cast(d2 <= " + str(NEAR) + " as int)")
    cte("within", f"SELECT k0, k1, {weighed} FROM last GROUP BY 1, 2")
    cte("withinpool", f"SELECT sum(n) AS n, {each(lambda i: f'sum(s{i}) AS s{i}')}, {both(lambda i, j: f'sum(q{i}{j}) AS q{i}{j}')} FROM within")
    fitted("final", "within", "withinpool", NEAR_SCALE, "k0, k1")
    distance("judged", "x", "final", "LEFT")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(d2 > {CUT}, false) AS kept FROM judged"""


#: Units and cuts by list slices; the text itself is what must come back.
OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|(?s:[^A-Za-z])') AS u, sha256('1:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2, ('0x' || h[17:24])::bigint AS h3, ('0x' || h[25:32])::bigint AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

#: Equal words at each distance up to a quarter of the text, their unbroken stretches, the smallest period of each.
#: crc32 by its table, byte by byte of the decimal id.
OP12 = r"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
sums(doc_id, s, k, c) AS (SELECT DISTINCT doc_id, doc_id::varchar, 0, 4294967295::bigint FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, k + 1, xor(c // 256, tab[xor(c % 256, ascii(s[k + 1])) + 1]) FROM sums, crc WHERE k < length(s)),
h AS (SELECT doc_id, xor(c, 4294967295::bigint) AS h FROM sums WHERE k = length(s)),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
a AS (SELECT w.*, len(ws) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w LEFT JOIN h ON w.doc_id = h.doc_id),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
u AS (SELECT doc_id, n, unnest(range(n)) AS i, a, p, ws FROM p),
x AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w FROM u),
e AS (SELECT y.doc_id, z.i - y.i AS q, y.i, y.i - row_number() OVER (PARTITION BY y.doc_id, z.i - y.i ORDER BY y.i) AS island
      FROM x y JOIN x z ON y.doc_id = z.doc_id AND y.w = z.w AND z.i > y.i AND 4 * (z.i - y.i) <= y.n),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM e GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY 1, 2, 3),
g AS (SELECT doc_id, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, arg_min(length, (-length, start, period)) AS length, arg_min(period, (-length, start, period)) AS period,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i WHERE c.i IS NULL GROUP BY 1)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN k ON w.doc_id = k.doc_id
"""

OP13 = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM t),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (top <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (top IS NULL OR top = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key GROUP BY 1
"""

ORACLE = {"op1_quality_rules": op1(), "op2_exact_dedup": OP2, "op5_jaccard_join": OP5, "op8_substring_dedup": OP8, "op10_url_filter": OP10, "op11_fill_in_middle": OP11, "op12_periodic_runs": OP12, "op13_line_dedup": OP13}
