"""SQL of the named queries, for an engine without look-around in patterns: runs of characters are taken whole and
judged by a full match instead."""

from __future__ import annotations

from maskwright.functions import fixed
from maskwright.plans.queries import SEED

IP_RUN = r"((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:\.(?:\..*)?)?"
MAIL = r"(?:[\p{L}\p{N}_]*[^\x00-\x7F][A-Za-z0-9_]*)?([A-Za-z0-9._%+\-]*@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"


def words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in sorted(set(values))) + ")"


def octets(ip: str) -> str:
    return f"list_max(list_transform(string_split({ip}, '.'), lambda p: p::BIGINT)) <= 255"


def number(ip: str) -> str:
    return "(" + " + ".join(f"string_split({ip}, '.')[{i + 1}]::BIGINT * {1 << (24 - 8 * i)}" for i in range(4)) + ")"


def inside(n: str, network: int, length: int) -> str:
    return f"({n} >> {32 - length}) = {network >> (32 - length)}"


def any_class(n: str, classes) -> str:
    return "(" + " OR ".join(inside(n, a, p) for a, p in classes) + ")"


def ip_class(n: str) -> str:
    return f"CASE WHEN {any_class(n, fixed.KEPT_CLASSES)} THEN 'kept' WHEN {any_class(n, fixed.TREE_CLASSES)} THEN 'private' ELSE 'public' END"


def ips(name: str, id_col: str, text: str) -> str:
    """Rows id, ip of a table."""
    run = f"SELECT {id_col} AS id, unnest(regexp_extract_all({text}, '[0-9.]+')) AS run FROM {name}"
    match = f"SELECT id, regexp_extract(run, '{IP_RUN}', 1) AS ip FROM ({run}) WHERE regexp_full_match(run, '{IP_RUN}')"
    return f"SELECT id, ip FROM ({match}) WHERE {octets('ip')}"


def emails(name: str, id_col: str, text: str) -> str:
    """Rows id, pos, email of a table."""
    every = f"SELECT {id_col} AS id, regexp_extract_all({text}, '{MAIL}', 1) AS found FROM {name}"
    rows = f"SELECT id, unnest(found) AS email, generate_subscripts(found, 1) AS pos FROM ({every})"
    return rf"SELECT * FROM ({rows}) WHERE NOT starts_with(email, '@') AND NOT regexp_matches(email, '@[0-9]+\.')"


DOC_IPS = ips("documents", "doc_id", "text")
DOC_MAILS = emails("documents", "doc_id", "text")


def tree(ip: str, source: str | None = None) -> str:
    """Rows ip, fake: the address text of the pseudonym of each strict address of the source that is not kept."""
    n = number(ip)
    pick = lambda values, other: "CASE " + " ".join(f"WHEN {inside('n', a, p)} THEN {v}" for (a, p), v in zip(fixed.TREE_CLASSES, values, strict=True)) + f" ELSE {other} END"
    start = pick([p for _, p in fixed.TREE_CLASSES], 4)
    head = pick([f"'{p}'" for _, p in fixed.TREE_CLASSES], "'P' || (n >> 28)::VARCHAR")
    base = pick([a for a, _ in fixed.TREE_CLASSES], 0xF0000000)
    stop = pick([24] * 4, 32)
    keyed = f"(strpos('13579bdf', right(sha256('{SEED}:' || head || ':' || substring(b, start + 1, bit - start)), 1)) > 0)"
    real = "substring(b, bit + 1, 1)::BIGINT"
    flips = f"CASE WHEN stop = 24 THEN bit = start OR {keyed} ELSE {keyed} END"
    new = f"CASE WHEN bit >= stop THEN {real} WHEN {flips} THEN 1 - {real} ELSE {real} END"
    text = " || '.' || ".join(f"((f >> {s}) & 255)::VARCHAR" for s in (24, 16, 8, 0))
    return f"""SELECT ip, {text} AS fake FROM (
      SELECT ip, any_value(base) + sum(CASE WHEN bit >= start THEN ({new}) * (1::BIGINT << (31 - bit)) ELSE 0 END)::BIGINT AS f FROM (
        SELECT *, unnest(range(4, 32)) AS bit FROM (
          SELECT ip, n, lpad(bin(n), 32, '0') AS b, {start} AS start, {head} AS head, {base}::BIGINT AS base, {stop} AS stop
          FROM (SELECT DISTINCT ip, {n} AS n FROM ({source or DOC_IPS}) WHERE NOT regexp_matches(ip, '(^|\\.)0[0-9]'))
          WHERE NOT {any_class('n', fixed.KEPT_CLASSES)}))
      GROUP BY ip)"""


MAPPING = tree("ip")
SEGMENTS = f"""SELECT doc_id, string_agg(coalesce(fake || substring(seg, length(ip) + 1), seg), '' ORDER BY pos) AS new FROM (
  SELECT doc_id, pos, seg, CASE WHEN regexp_full_match(seg, '{IP_RUN}') THEN regexp_extract(seg, '{IP_RUN}', 1) END AS own FROM (
    SELECT doc_id, unnest(segs) AS seg, generate_subscripts(segs, 1) AS pos FROM (
      SELECT doc_id, regexp_extract_all(text, '[0-9.]+|[^0-9.]+') AS segs FROM documents)))
  LEFT JOIN mapping ON own = ip GROUP BY doc_id"""
REWRITTEN = f"""mapping AS ({MAPPING}), segments AS ({SEGMENTS}),
rewritten AS (SELECT doc_id, lang, coalesce(text, '') AS text, coalesce(new, text, '') AS new FROM documents LEFT JOIN segments USING (doc_id))"""
LINES = "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS a, unnest(string_split(new, chr(10))) AS b FROM rewritten"
FILES = f"""{REWRITTEN}, lines AS ({LINES}),
counts AS (SELECT doc_id, any_value(lang) AS lang, count(*) FILTER (a IS DISTINCT FROM b) AS changed, count(*) AS lines FROM lines GROUP BY doc_id),
leaks AS (SELECT id, count(*) AS leaks FROM ({emails('rewritten', 'doc_id', 'new')}) GROUP BY id),
files AS (SELECT doc_id, lang, changed, coalesce(leaks, 0) AS leaks,
  CASE WHEN leaks > 0 THEN 'error' WHEN changed > 0 THEN 'anonymized' ELSE 'identical' END AS status
  FROM counts LEFT JOIN leaks ON id = doc_id)"""
TEXTS = "texts AS (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages)"
HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)', 1))"
PARENTS = f"""SELECT id, host, level, domain FROM (
  SELECT id, host, level, array_to_string(parts[level + 1:], '.') AS domain, parts[level + 1] AS label, len(parts) AS n FROM (
    SELECT id, host, parts, unnest(range(0, greatest(len(parts) - 1, 1))) AS level FROM (
      SELECT page_id AS id, {HOST} AS host, string_split({HOST}, '.') AS parts FROM pages WHERE {HOST} <> '')))
  WHERE level = 0 OR (label NOT IN {words(fixed.DOMAIN_STOPWORDS)} AND length(label) >= 2
    AND NOT regexp_full_match(label, '[0-9]+') AND regexp_matches(domain, '[a-z]'))"""
KEPT_HOST = "(" + " OR ".join(f"domain = '{d}' OR ends_with(domain, '.{d}')" for d in fixed.VENDOR_DOMAINS) + f" OR domain IN {words(fixed.BUILTIN_NAMES)})"
NAMES = "names AS (SELECT c_name AS original, 'USR' AS prefix, c_custkey * 2 AS seq FROM customer UNION ALL SELECT s_name, 'GRP', s_suppkey * 2 + 1 FROM supplier)"
PAD4 = "prefix || '-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0')"


def oracle_sql() -> dict[str, str]:
    number_ip = number("ip")
    containing = " UNION ".join(f"SELECT DISTINCT ({number_ip} >> {32 - p}) << {32 - p} AS net, {p} AS plen FROM ({DOC_IPS})" for p in (8, 12, 16, 24, 32))
    net_text = " || '.' || ".join(f"((net >> {s}) & 255)::VARCHAR" for s in (24, 16, 8, 0))
    public = f"NOT {any_class(number('value'), [(sum(int(p) << s for p, s in zip(n.split('/')[0].split('.'), (24, 16, 8, 0), strict=True)), int(n.split('/')[1])) for n in fixed.RESERVED_NETWORKS])}"
    from maskwright.plans import fleet_oracles

    return fleet_oracles.oracle_sql() | {
        "q45_text_verdicts": f"""WITH {FILES} SELECT doc_id, CASE WHEN changed > 0 THEN 'anonymized' ELSE 'identical' END AS status, changed AS changed_lines, changed AS explained_lines,
            0 AS unexplained_lines, 0 AS leak_count FROM files""",
        "q01_detect_ipv4": f"SELECT id AS doc_id, ip, count(*) AS n FROM ({DOC_IPS}) GROUP BY ALL",
        "q02_detect_email": f"""WITH {TEXTS} SELECT source, id, lower(email) AS email, count(*) AS n FROM (
            SELECT 'documents' AS source, * FROM ({DOC_MAILS}) UNION ALL SELECT 'pages', * FROM ({emails('pages', 'page_id', 'html')})) GROUP BY ALL""",
        "q03_identity_census": f"""SELECT source, kind, count(*) AS occurrences, count(DISTINCT value) AS identities, count(DISTINCT id) AS texts FROM (
            SELECT 'documents' AS source, 'ip' AS kind, id, ip AS value FROM ({DOC_IPS}) UNION ALL SELECT 'pages', 'ip', id, ip FROM ({ips('pages', 'page_id', 'html')})
            UNION ALL SELECT 'documents', 'email', id, lower(email) FROM ({DOC_MAILS}) UNION ALL SELECT 'pages', 'email', id, lower(email) FROM ({emails('pages', 'page_id', 'html')})) GROUP BY ALL""",
        "q04_ip_classes": f"SELECT class, count(*) AS n, count(DISTINCT ip) AS addresses FROM (SELECT ip, {ip_class(number_ip)} AS class FROM ({DOC_IPS})) GROUP BY ALL",
        "q05_ip_pseudonym": f"SELECT ip, fake FROM ({MAPPING})",
        "q06_email_pseudonym": f"""WITH found AS (SELECT lower(email) AS email, min(id * (1 << 20) + pos) AS seq FROM ({DOC_MAILS}) GROUP BY 1),
            hosts AS (SELECT domain, min(seq) AS seq FROM (SELECT split_part(email, '@', -1) AS domain, seq FROM found) WHERE NOT {KEPT_HOST} GROUP BY 1),
            named AS (SELECT domain, 'host' || lpad(row_number() OVER (ORDER BY seq)::VARCHAR, 3, '0') || '.anon.internal' AS fake FROM hosts)
            SELECT email, 'user' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || '@' || coalesce(named.fake, split_part(email, '@', -1)) AS fake
            FROM (SELECT email, row_number() OVER (ORDER BY seq, email) AS n FROM found) LEFT JOIN named ON domain = split_part(email, '@', -1)""",
        "q07_host_parents": f"SELECT DISTINCT host, domain, {KEPT_HOST} AS kept FROM ({PARENTS})",
        "q08_host_pseudonym": f"""WITH firsts AS (SELECT domain, min(id * 16 + least(level, 15)) AS seq FROM ({PARENTS}) WHERE NOT {KEPT_HOST} GROUP BY 1),
            ranked AS (SELECT domain, row_number() OVER (ORDER BY seq, domain) AS n FROM firsts)
            SELECT domain AS host, 'host' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || CASE WHEN contains(domain, '.') THEN '.anon.internal' ELSE '' END AS fake FROM ranked""",
        "q09_object_pseudonym": f"WITH {NAMES} SELECT original, {PAD4} AS pseudonym FROM (SELECT *, row_number() OVER (ORDER BY seq, original) AS n FROM names)",
        "q10_seeded_resume": f"""WITH {NAMES}, old AS (SELECT *, row_number() OVER (ORDER BY seq, original) AS n FROM names WHERE seq % 3 = 0)
            SELECT original, {PAD4} AS pseudonym FROM old UNION ALL SELECT original, {PAD4} FROM (
            SELECT *, row_number() OVER (ORDER BY seq, original) + (SELECT count(*) FROM old) AS n FROM names WHERE seq % 3 <> 0)""",
        "q11_duplicates_collisions": f"""WITH naive AS (SELECT DISTINCT ip AS original, split_part(ip, '.', 1) || '.0.0.1' AS pseudonym FROM ({DOC_IPS})),
            mapping AS (SELECT * FROM naive UNION SELECT DISTINCT pseudonym, '240.0.0.1' FROM naive)
            SELECT 'duplicate' AS kind, pseudonym AS value, count(DISTINCT original) AS n FROM mapping GROUP BY 2 HAVING count(DISTINCT original) > 1
            UNION ALL SELECT DISTINCT 'collision', original, 1 FROM mapping WHERE original <> pseudonym AND original IN (SELECT pseudonym FROM mapping WHERE original <> pseudonym)""",
        "q12_rewrite_ip_text": f"WITH {REWRITTEN} SELECT doc_id, md5(new) AS digest FROM rewritten",
        "q13_replacement_counts": f"""WITH mapping AS ({MAPPING}) SELECT id AS doc_id, 'ip_addresses' AS class, count(*) AS n FROM ({DOC_IPS}) a JOIN mapping ON a.ip = mapping.ip GROUP BY ALL
            UNION ALL SELECT id, 'emails', count(*) FROM ({DOC_MAILS}) GROUP BY ALL""",
        "q14_leak_scan": f"""WITH {REWRITTEN}, keys AS (SELECT ip AS key FROM mapping UNION SELECT lower(email) FROM ({DOC_MAILS})),
            found AS (SELECT ip AS key FROM ({ips('rewritten', 'doc_id', 'new')}) UNION ALL SELECT lower(email) FROM ({emails('rewritten', 'doc_id', 'new')}))
            SELECT key, count(*) AS n FROM found WHERE key IN (SELECT key FROM keys) GROUP BY key""",
        "q15_lines": "SELECT doc_id, n, md5(line) AS digest FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))",
        "q16_changed_lines": f"WITH {REWRITTEN}, lines AS ({LINES}) SELECT doc_id, count(*) FILTER (a IS DISTINCT FROM b) AS changed, count(*) FILTER (a IS NOT DISTINCT FROM b) AS unchanged FROM lines GROUP BY doc_id",
        "q17_numeric_tokens": r"SELECT page_id, len(list_filter(regexp_extract_all(html, '[\p{L}\p{N}_.\-]+'), lambda t: regexp_full_match(t, '[0-9]{1,11}')))::BIGINT AS n FROM pages",
        "q18_timestamps": f"""WITH {TEXTS} SELECT source, count(*) AS n, coalesce(sum(len(regexp_extract_all(text, '{fixed.TIMESTAMP}'))), 0)::BIGINT AS stamps
            FROM (SELECT source, text FROM texts UNION ALL SELECT 'events', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events) GROUP BY source""",
        "q19_tag_sequence": "SELECT page_id, len(t)::BIGINT AS n, md5(array_to_string(t, ',')) AS digest FROM (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9-]*)', 1) AS t FROM pages)",
        "q20_free_text": f"""SELECT page_id, md5(regexp_replace(html, '<(title|h1)>([^<]*[^<\\s][^<]*)</(title|h1)>', '<\\1>{fixed.PLACEHOLDER}</\\3>', 'g')) AS digest,
            len(regexp_extract_all(html, '<(title|h1)>([^<]*[^<\\s][^<]*)</(title|h1)>'))::BIGINT AS n FROM pages""",
        "q21_binary_heuristic": r"""WITH versions AS (SELECT doc_id, 'plain' AS version, text AS t FROM documents UNION ALL SELECT doc_id, 'some', translate(text, 'et', chr(1) || chr(2)) FROM documents
            UNION ALL SELECT doc_id, 'many', translate(text, 'aeioutrn', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8)) FROM documents),
            heads AS (SELECT doc_id, version, substring(hex(encode(t)), 1, 8192) AS h FROM versions),
            counts AS (SELECT doc_id, version, length(h) // 2 AS size, len(regexp_extract_all(regexp_replace(h, '(..)', '\1 ', 'g'), '(0[1-8]|0[EF]|1[0-9A-F]|7F) ')) AS control FROM heads)
            SELECT doc_id, version, size > 0 AND control > 0.30 * size AS binary FROM counts""",
        "q22_referential_join": "SELECT c_mktsegment AS segment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "q23_member_diff": """WITH b AS (SELECT n_nationkey::BIGINT AS key, n_name, n_regionkey::BIGINT AS region FROM nation),
            a AS (SELECT key, CASE WHEN key % 5 = 2 THEN lower(n_name) ELSE n_name END AS n_name, region FROM b WHERE key % 7 <> 3 UNION ALL SELECT key + 100, n_name, region FROM b WHERE key % 6 = 0)
            SELECT coalesce(b.key, a.key) AS key, CASE WHEN a.key IS NULL THEN 'missing' WHEN b.key IS NULL THEN 'extra' WHEN a.n_name = b.n_name AND a.region = b.region THEN 'same' ELSE 'changed' END AS status FROM b FULL JOIN a ON a.key = b.key""",
        "q24_slash24_groups": f"""SELECT {ip_class(number_ip)} AS class, count(*) AS n, count(DISTINCT regexp_extract(ip, '^[0-9]+[.][0-9]+[.][0-9]+')) AS nets,
            count(DISTINCT regexp_extract(fake, '^[0-9]+[.][0-9]+[.][0-9]+')) AS fake_nets FROM ({MAPPING}) GROUP BY 1""",
        "q25_containment": f"""WITH nets AS (SELECT *, {net_text} || '/' || plen AS idx FROM ({containing}))
            SELECT i.idx AS inner, o.idx AS outer FROM nets i JOIN nets o ON o.plen <= i.plen AND (i.net >> (32 - o.plen)) = (o.net >> (32 - o.plen))""",
        "q26_status_summary": f"""WITH {FILES} SELECT count(*) AS files_total, count(*) FILTER (status = 'identical') AS identical, count(*) FILTER (status = 'anonymized') AS anonymized,
            count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'error') AS error, coalesce(sum(changed), 0)::BIGINT AS changed_lines,
            coalesce(sum(leaks), 0)::BIGINT AS leaks_total, count(*) FILTER (leaks > 0) AS files_with_leaks FROM files""",
        "q27_report_page": f"""WITH {FILES} SELECT doc_id, lang, status, (SELECT count(*) FROM files WHERE status IN ('identical', 'anonymized') AND contains(lower(lang), 'e')) AS total
            FROM files WHERE status IN ('identical', 'anonymized') AND contains(lower(lang), 'e') ORDER BY doc_id LIMIT 40 OFFSET 5""",
        "q28_top_leaks": f"SELECT key, count(*) AS n FROM (SELECT ip AS key FROM ({DOC_IPS}) UNION ALL SELECT lower(email) FROM ({DOC_MAILS})) GROUP BY key ORDER BY n DESC, key LIMIT 50",
        "q29_diff_hunks": """WITH lines AS (SELECT doc_id, len(ls) AS total, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
            gaps AS (SELECT doc_id, total, n, CASE WHEN n - lag(n) OVER (PARTITION BY doc_id ORDER BY n) <= 7 THEN 0 ELSE 1 END AS new FROM lines WHERE regexp_matches(line, '[0-9#&]')),
            islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS hunk FROM gaps)
            SELECT doc_id, hunk::BIGINT AS hunk, greatest(1, min(n) - 3)::BIGINT AS start, least(max(total), max(n) + 3)::BIGINT AS end FROM islands GROUP BY doc_id, hunk""",
        "q30_phase_durations": """SELECT user_id, event_type, coalesce(sum(us), 0)::BIGINT AS micros FROM (
            SELECT user_id, event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type)) - epoch_us(ts) AS us FROM events) GROUP BY ALL""",
        "q31_latest_in_group": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
        "q32_chain_walk": """WITH RECURSIVE links AS (SELECT event_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seed_from FROM events),
            walk AS (SELECT event_id, seed_from AS prior, 1 AS depth FROM links WHERE seed_from IS NOT NULL
              UNION ALL SELECT walk.event_id, l.seed_from, depth + 1 FROM walk JOIN links l ON l.event_id = walk.prior WHERE l.event_type <> 'purchase' AND l.seed_from IS NOT NULL)
            SELECT walk.event_id, prior AS ancestor, depth::BIGINT AS depth FROM walk JOIN links l ON l.event_id = walk.prior WHERE l.event_type = 'purchase'""",
        "q33_stopwords": f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)
            WHERE token NOT IN {words(fixed.USER_STOPWORDS + fixed.BUILTIN_NAMES + fixed.DOMAIN_STOPWORDS)} GROUP BY token""",
        "q34_policy_scan": rf"""WITH {TEXTS}, tokens AS (SELECT source, id, unnest(regexp_extract_all(text, '[0-9.]+')) AS value FROM texts),
            found AS (SELECT source, id, 'ip' AS kind, value FROM tokens WHERE regexp_full_match(value, '(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}')
              AND {octets('value')} AND NOT regexp_matches(value, '(^|\.)0[0-9]') AND {public}
              UNION ALL SELECT source, id, 'email', value FROM (SELECT source, id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}')) AS value FROM texts)
              WHERE NOT regexp_matches(lower(value), '(@|\.)example\.com$') AND NOT regexp_matches(lower(value), '\.(example|test|invalid|localhost)$')
              UNION ALL SELECT source, id, 'host', value FROM (SELECT source, id, unnest(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_.-])((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+(?:com|net|org))', 1)) AS value FROM texts)
              WHERE NOT regexp_matches(lower(value), '(^|\.)example\.com$')
              UNION ALL SELECT source, id, 'serial', value FROM tokens WHERE regexp_full_match(value, '0[0-9]{{11}}'))
            SELECT source, id, kind, value, count(*) AS n FROM found GROUP BY ALL""",
        "q35_numbered_events": "SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) AS number FROM events",
    }
