"""SQL of the queries on the fleet of archives: what must be found follows from the tables the fleet is built from. No text
is read here; texts are only built where their length is asked for."""

from __future__ import annotations

from maskwright.plans import fleet
from maskwright.plans.oracles import number, tree

CONFIG, LOG, OLD, ROUTED, BINARY = (
    "opt/saved-configs/running-config.xml", "var/log/pan/system.log", "var/log/pan/system.log.1.gz", "var/log/pan/routed.log", "var/log/pan/hits.bin",
)


def octets(first: str, key: str) -> str:
    return f"'{first}.' || (({key} // 254) % 254 + 1) || '.' || ({key} % 254 + 1)"


#: sites: a row for each nation. suppliers and lines: its suppliers and its customers' orders, numbered from 1 in the site.
SITES = f"""sites AS (SELECT n_nationkey::BIGINT AS n, 'site' || lpad(n_nationkey::VARCHAR, 3, '0') || '.tgz' AS archive, 'edge-fw-' || n_nationkey AS device,
  'site' || n_nationkey || '.fleet-harbor.net' AS domain, '01' || lpad(n_nationkey::VARCHAR, 10, '3') AS serial,
  'tmp/cli/techsupport_edge-fw-' || n_nationkey || '_20250101_1200.txt' AS tech FROM nation),
suppliers AS (SELECT s_nationkey::BIGINT AS n, s_suppkey AS key, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i,
  {octets("10.20", "s_suppkey")} AS inside, {octets("81.22", "s_suppkey")} AS outside FROM supplier),
lines AS (SELECT c_nationkey::BIGINT AS n, c_custkey AS cust, o_orderkey AS key, o_orderdate AS day, {octets("10.30", "c_custkey")} AS ip, c_custkey % 7 = 0 AS is_old,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS i FROM orders JOIN customer ON o_custkey = c_custkey),
per_site AS (SELECT sites.*, (SELECT count(*) FROM suppliers s WHERE s.n = sites.n) AS n_suppliers, (SELECT count(*) FROM lines l WHERE l.n = sites.n) AS n_lines,
  (SELECT count(*) FROM lines l WHERE l.n = sites.n AND is_old) AS n_old FROM sites)"""

_LINE = "strlen(strftime(day, '%Y-%m-%d') || ' 08:00:00 [authd] authenticated for user ''u' || cust || '.x'' from ' || ip || ' mail c' || cust || '@' || domain || ' count ' || (key % 1000)) + 1"
_CONFIG = (
    "strlen('<?xml version=\"1.0\"?>') + strlen('<config><devices><entry name=\"localhost.localdomain\"><deviceconfig><system>') + strlen('<hostname></hostname>') + strlen(device)"
    " + strlen('<domain></domain>') + strlen(domain) + strlen('<serial></serial>') + strlen(serial) + strlen('<login-banner>property of site') + strlen('call the desk</login-banner>')"
    " + strlen('</system></deviceconfig>') + strlen('<network><interface><ethernet><entry name=\"ethernet1/1\"><layer3><ip><entry name=\"172.16.4.1/30\"/></ip></layer3></entry></ethernet></interface></network>')"
    " + strlen('<vsys><entry name=\"vsys1\"><address>') + strlen('</address></entry></vsys></entry></devices></config>') + 11"
)
_TECH = (
    "strlen('> show system info') + strlen('hostname: ') + strlen(device) + strlen('serial: ') + strlen(serial) + strlen('> show routing route') + strlen('destination nexthop flags')"
    " + strlen('172.16.4.0/30 0.0.0.0 A C') + strlen('> show clock') + 9"
)
BYTES = f"""bytes AS (SELECT sites.n,
  {_CONFIG} + coalesce((SELECT sum(strlen('<entry name=\"' || name || '\"><ip-netmask>' || inside || '</ip-netmask></entry>') + 1) FROM suppliers s WHERE s.n = sites.n), 0) AS config,
  coalesce((SELECT sum({_LINE}) FROM lines l WHERE l.n = sites.n), 0) AS log, coalesce((SELECT sum({_LINE}) FROM lines l WHERE l.n = sites.n AND is_old), 0) AS old,
  coalesce((SELECT sum(strlen('2025-01-01 10:00:00 add route ' || outside || '/32 nexthop 172.16.4.2 interface ethernet1/1') + 1) FROM suppliers s WHERE s.n = sites.n), 0) AS routed,
  {_TECH} + coalesce((SELECT sum(strlen(outside || '/32 172.16.4.2 A B') + 1) FROM suppliers s WHERE s.n = sites.n), 0) AS tech FROM sites)"""

#: Findings in XML and system information.
FINDINGS = f"""findings AS (SELECT archive, '{CONFIG}' AS path, 0 AS pos, 'fqdn' AS kind, device AS value, '' AS category FROM sites
  UNION ALL SELECT archive, '{CONFIG}', 1, 'fqdn', domain, '' FROM sites UNION ALL SELECT archive, '{CONFIG}', 2, 'serial', serial, '' FROM sites
  UNION ALL SELECT archive, '{CONFIG}', 3, 'obj', 'ethernet1/1', 'obj' FROM sites UNION ALL SELECT archive, '{CONFIG}', 3 + i, 'obj', name, 'addr' FROM suppliers JOIN sites USING (n)
  UNION ALL SELECT archive, tech, 0, 'fqdn', device, '' FROM sites UNION ALL SELECT archive, tech, 1, 'fqdn', device, '' FROM sites UNION ALL SELECT archive, tech, 2, 'serial', serial, '' FROM sites)"""

PAD3 = "CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END"
ADDRESSES = "SELECT inside AS ip FROM suppliers UNION SELECT outside FROM suppliers UNION SELECT ip FROM lines UNION SELECT unnest(['172.16.4.0', '172.16.4.1', '172.16.4.2'])"
#: Devices by the names of their files, then domains with their common parent after the first; customers by their first line.
MAPPING = f"""devices AS (SELECT device AS original, serial, row_number() OVER (ORDER BY tech) AS k FROM sites),
domains AS (SELECT original, row_number() OVER (ORDER BY n, level) + (SELECT count(*) FROM sites) AS k FROM (
  SELECT domain AS original, n, 0 AS level FROM sites UNION ALL SELECT 'fleet-harbor.net', min(n), 1 FROM sites)),
customers AS (SELECT cust, any_value(domain) AS domain, row_number() OVER (ORDER BY any_value(archive), min(i)) AS k FROM lines JOIN sites USING (n) GROUP BY cust),
mapping AS (SELECT 'fqdns' AS category, original, 'host' || {PAD3} AS pseudonym FROM devices
  UNION ALL SELECT 'fqdns', original, 'host' || {PAD3} || '.anon.internal' FROM domains
  UNION ALL SELECT 'serial_numbers', serial, '9' || lpad(k::VARCHAR, 11, '0') FROM devices
  UNION ALL SELECT 'named_objects', name, 'ADDR-' || lpad(k::VARCHAR, greatest(4, length(k::VARCHAR))::INT, '0') FROM (SELECT name, row_number() OVER (ORDER BY archive, i) AS k FROM suppliers JOIN sites USING (n))
  UNION ALL SELECT 'usernames', 'u' || cust || '.x', 'user' || {PAD3} FROM customers
  UNION ALL SELECT 'emails', 'c' || cust || '@' || customers.domain, 'user' || CASE WHEN customers.k < 1000 THEN lpad(customers.k::VARCHAR, 3, '0') ELSE customers.k::VARCHAR END || '@host' ||
    CASE WHEN domains.k < 1000 THEN lpad(domains.k::VARCHAR, 3, '0') ELSE domains.k::VARCHAR END || '.anon.internal' FROM customers JOIN domains ON domains.original = customers.domain
  UNION ALL SELECT 'ip_addresses', ip, fake FROM ({tree("ip", ADDRESSES)}))"""

#: Routes in their order: the routing table, then events, then connected networks.
ROUTES = f"""rows AS (SELECT archive, tech AS path, 0 AS pos, 'rib' AS source, '172.16.4.0/30' AS raw, NULL AS nexthop, 1 AS idx, 1 AS key FROM sites
  UNION ALL SELECT archive, tech, i + 1, 'rib', outside || '/32', NULL, i + 1, i + 1 FROM suppliers JOIN sites USING (n)
  UNION ALL SELECT archive, '{ROUTED}', i - 1, 'event', outside || '/32', '172.16.4.2', n_suppliers + 1 + i, i + 1 FROM suppliers JOIN per_site USING (n)
  UNION ALL SELECT archive, '{CONFIG}', 0, 'connected', '172.16.4.1/30', NULL, 2 * n_suppliers + 2, 2 * n_suppliers + 2 FROM per_site
  UNION ALL SELECT archive, tech, 1, 'connected', '172.16.4.0/30', NULL, 2 * n_suppliers + 3, 2 * n_suppliers + 3 FROM per_site)"""


def oracle_sql() -> dict[str, str]:
    folders = " UNION ALL ".join(f"SELECT archive, {i} AS seq, '{f}' AS path, 'dir' AS type, 493 AS mode, 0 AS uid, 0 AS gid, '' AS uname, 0 AS bytes, 'dir' AS kind FROM sites" for i, f in enumerate(fleet.FOLDERS))
    files = ((f"'{CONFIG}'", "config", "text"), (f"'{LOG}'", "log", "text"), (f"'{OLD}'", "old", "gz_text"), (f"'{ROUTED}'", "routed", "text"), (f"'{BINARY}'", str(len(fleet.BINARY)), "binary"), ("sites.tech", "bytes.tech", "text"))
    members = " UNION ALL ".join(
        f"SELECT archive, {len(fleet.FOLDERS) + i}, {path}, 'file', 416, 1234, 1234, 'pan', {size}, '{kind}' FROM sites JOIN bytes USING (n)" for i, (path, size, kind) in enumerate(files)
    )
    total = "(SELECT sum(n_suppliers) FROM per_site)::BIGINT AS s, (SELECT sum(n_lines + n_old) FROM per_site)::BIGINT AS l, (SELECT count(*) FROM sites) AS c"
    modified = "(SELECT sum(2 + (n_lines > 0)::INT + (n_old > 0)::INT + (n_suppliers > 0)::INT) FROM per_site)"
    zeros = ("warnings", "errors", "unexplained_lines", "line_count_mismatches", "leaks_total", "files_with_leaks", "binary_files_with_identifiers", "binary_redacted", "free_text_survivals", "timestamp_mismatches", "numeric_mismatches", "xml_structure_changed", "archive_mismatches")
    relations = ("structure", "prefix length", "next hop in connected", "containment", "connected in route")
    net = number("split_part(raw, '/', 1)")
    return {
        "q36_archive_members": f"WITH {SITES}, {BYTES} SELECT archive, seq, path, type, mode, uid, gid, uname, {fleet.MTIME} AS mtime, bytes::BIGINT AS bytes, kind FROM ({folders} UNION ALL {members})",
        "q37_xml_findings": f"WITH {SITES}, {FINDINGS} SELECT * FROM findings",
        "q38_mapping": f"WITH {SITES}, {MAPPING} SELECT * FROM mapping",
        "q39_outcomes": f"""WITH {SITES}, totals AS (SELECT {total}, {modified}::BIGINT AS m) SELECT 6 * c AS files, m AS modified, 5 * c - m AS unchanged, c AS binary, 0 AS gz_binary, 0 AS redacted, 0 AS error, c AS n_redacted,
            5 * s + 2 * c + l AS ip_addresses, l AS usernames, 3 * c AS fqdns, l AS emails, s AS named_objects, 2 * c AS serial_numbers FROM totals""",
        "q40_verdict": f"""WITH {SITES}, totals AS (SELECT {total}, {modified}::BIGINT AS m) SELECT 6 * c AS files_total, 6 * c - m AS identical, m AS anonymized, 5 * c AS text_files, c AS binary_files, c AS binary_identical,
            9 * c + 3 * s + l AS changed_lines, 9 * c + 3 * s + l AS explained_lines, c AS xml_checked, {", ".join(f"0 AS {z}" for z in zeros)}, true AS ok FROM totals""",
        "q41_routes": f"""WITH {SITES}, {ROUTES} SELECT archive, path, pos, source, raw, coalesce(nexthop, '') AS nexthop, idx, split_part(raw, '/', 2)::INT AS plen,
            {net} - {net} % (1::BIGINT << (32 - split_part(raw, '/', 2)::INT)) AS net, CASE WHEN nexthop IS NOT NULL THEN {172 << 24 | 16 << 16 | 4 << 8 | 2} ELSE -1 END AS hop, key FROM rows""",
        "q42_routing_coherence": "SELECT * FROM (VALUES " + ", ".join(f"('{r}', 0, 0)" for r in relations) + ") AS t(relation, mismatches, public_divergences)",
    }
