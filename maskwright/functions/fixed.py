"""Values that results depend on. They are data, not logic: lists, patterns and formats, in natural order."""

from __future__ import annotations

# Patterns. JVM spellings; [0-9] and explicit letter classes, so that Java and Python agree.
LETTER = r"\p{L}\p{N}_"
IPV4 = r"(?<![.0-9])([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(/[0-9]{1,2})?(?![0-9])(?!\.[0-9])"
EMAIL = (
    rf"(?:(?<=[{LETTER}])(?=[.%+\-])|(?<![{LETTER}])(?=[a-zA-Z0-9_]))([a-zA-Z0-9._%+\-]+)"
    rf"@((?![0-9]+\.)[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}})(?![{LETTER}])(?![\-_][{LETTER}])"
)
USER_PHRASE = (
    r"(?:authenticated\s+for\s+user\s+['\"]|for\s+user\s+['\"]|(?:non-admin\s+)?user(?:name)?[=:,\s]+['\"]"
    r"|user\s+thru\s+\S+\s+['\"])([a-zA-Z][a-zA-Z0-9._@-]+)['\"]?"
)
HOSTNAME_PHRASE = (
    rf"(?:(?<![{LETTER}])hostname[:=][ \t]*[\"']?|(?<![{LETTER}])hostname[ \t]+)([A-Za-z][A-Za-z0-9._-]{{2,62}})(?=[\"',;\s]|\z)"
)
SERIAL = (
    r"(?<![.0-9])(?!(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[01][0-9]|2[0-3])[0-5][0-9](?:19|20)[0-9][0-9](?![0-9]))"
    r"(0(?!000)[0-9]{11}|007[0-9]{12})(?![0-9])"
)
TIMESTAMP = (
    r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}\b"
)
NUMERIC_TOKEN = rf"(?<![{LETTER}.\-])[0-9]{{1,11}}(?![{LETTER}.\-])"
IP_LIKE = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:/[0-9]{1,2})?(?:-[0-9]{1,3}(?:\.[0-9]{1,3}){3})?$"
FQDN_LIKE = r"^(?=.*[A-Za-z])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"
DOMAIN_USER = r"^([A-Za-z][A-Za-z0-9.-]{1,62})\\+([A-Za-z0-9][A-Za-z0-9._@$-]{0,63})$"
INTERFACE = r"(?i)^(?:ethernet[0-9]+/[0-9]+(?:\.[0-9]+)?|ae[0-9]+(?:\.[0-9]+)?|tunnel\.[0-9]+|loopback\.[0-9]+|vlan\.[0-9]+|hsci[0-9]*)$"
FILE_SUFFIX = (
    r"(?i)\.(?:gz|log|xml|txt|json|js|css|png|jpg|pem|crt|csr|key|pcap|tar|tgz|zip|service|socket|journal|yang|stats|cfg|acl|conf"
    r"|d|ha|[0-9]+)$"
)
VOCABULARY_NAME = r"^[a-z][a-z0-9]{0,11}$"
CERTIFICATE_NAME = r"(?<![A-Za-z])CN\s*=\s*([^,/\n]+)"
DOMAIN_COMPONENT = r"(?i)DC=([^,]+)"
TECHSUPPORT_NAME = r"^techsupport_(.+)_([0-9]{8})_([0-9]{4})\.txt$"
MODEL_LIKE = r"(?i)^(?:PA|VM|M|PAN|WF|CN)-?[0-9]"
RIB_ROW = r"^\s*([0-9]{1,3}(?:\.[0-9]{1,3}){3}/[0-9]{1,2})\s+(?:\S+\s+)?([0-9]{1,3}(?:\.[0-9]{1,3}){3})?"
ROUTE_EVENT = (
    r"(?i)\b(?:add|delete)\s+route\s+([0-9]{1,3}(?:\.[0-9]{1,3}){3}/[0-9]{1,2})\s+nexthop\s+([0-9]{1,3}(?:\.[0-9]{1,3}){3})"
)
ROUTE_SECTION = r"(?sm)^> show (?:advanced-)?routing route.*?(?=^> |\Z)"
BGP_SECTION = r"(?sm)^> show (?:routing protocol|advanced-routing) bgp (?:loc-rib|rib-out)(?:-detail)?.*?(?=^> |\Z)"
OSPF_SECTION = r"(?sm)^> show (?:routing protocol|advanced-routing) ospf(?:v3)? dumplsdb.*?(?=^> |\Z)"
BGP_TOKEN = r"Prefix:\s*([0-9]{1,3}(?:\.[0-9]{1,3}){3}/[0-9]{1,2})|Nexthop:\s*([0-9]{1,3}(?:\.[0-9]{1,3}){3})"
OSPF_SUMMARY = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3}/[0-9]{1,2})\s+type-3\b"
GLUED_DATE = r"(?:19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9]"

# Address classes, as (first address, prefix length).
TREE_CLASSES = ((10 << 24, 8), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (100 << 24 | 64 << 16, 10))
KEPT_CLASSES = ((0, 32), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (224 << 24, 3))
RESERVED_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "255.255.255.255/32",
)

# Formats and sentinels.
CATEGORIES = ("ip_addresses", "usernames", "fqdns", "emails", "named_objects", "serial_numbers")
PLACEHOLDER = "REDACTED-FREE-TEXT"
REDACTED_BINARY = b"[redacted binary payload: the original embedded mapped identifiers]\n"
FREE_TEXT_TAGS = ("description", "comments", "comment", "login-banner", "location")
FREE_TEXT_KEYWORDS = ("description", "comments", "comment", "login-banner", "location")
VENDOR_TAGS = ("predefined", "threats", "application-type", "global")
SKIPPED_SUBTREES = ("predefined", "threats", "application-type")
CATALOGUE_IN_CONFIG = ("config", "global")

# Files.
BINARY_SUFFIXES = (
    ".bin", ".dat", ".db", ".sqlite", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".rpm", ".deb", ".so", ".a",
    ".pyc", ".pyo", ".whl", ".egg", ".core", ".pcap", ".cap",
)
UNSCANNED_NAMES = ("predefined.xml", "global.xml", "reg_ips.xml", "sysd_objects_meta.xml")
UNSCANNED_FOLDERS = ("updates", "regip", "healthchecks")
MOST_FILES = 200_000
MOST_BYTES = 8 << 30
MOST_CONFIG_BYTES = 200 << 20

# Names that identify nobody.
BUILTIN_NAMES = (
    "any", "trust", "untrust", "outside", "inside", "mgmt", "loopback", "tunnel", "vlan", "application-default", "interzone-default",
    "intrazone-default", "service-http", "service-https", "service-ftp", "service-smtp", "service-dns", "reject", "deny", "allow",
    "drop", "default", "shared", "localhost", "localhost.localdomain", "vsys1", "vsys2", "vsys3", "vsys4", "panorama", "admin",
    "root", "system", "pre-logon", "none", "yes", "no", "true", "false", "www", "bgp", "ospf", "ospfv3", "rip", "bfd", "pim",
    "igmp", "msdp", "vrrp",
)
USER_STOPWORDS = (
    "error", "request", "block", "usr", "port", "cli", "api", "gui", "console", "shell", "sync", "cron", "ntp", "snmp", "syslog",
    "radius", "ldap", "tacacs", "saml", "kerberos", "local", "panorama", "user", "username", "login", "logout", "unknown",
    "invalid", "failed", "success", "warning", "info", "debug", "password", "session", "service", "config", "status", "level",
    "count", "system", "default", "none", "null", "test", "test1", "guest", "guest1", "demo", "temp", "tmp", "backup", "printer",
    "scanner", "camera", "oracle", "postgres", "mysql", "ftp", "ftpuser", "ssh", "vpn", "pi", "ubuntu", "support", "sales",
    "marketing", "office", "manager", "operator", "monitor", "nagios", "zabbix", "cisco", "web", "mail", "email", "sysadmin",
    "administrator", "superuser", "anonymous", "nobody", "daemon", "bin", "sys", "adm", "git", "jenkins", "docker", "tomcat",
    "apache", "nginx", "student", "staff", "remote", "access", "security", "firewall", "router", "switch", "ubnt", "user1",
)
VENDOR_DOMAINS = (
    "paloaltonetworks.com", "google.com", "microsoft.com", "amazonaws.com", "cloudflare.com", "akamai.com", "office365.com",
    "microsoftonline.com", "wildfire.paloaltonetworks.com", "updates.paloaltonetworks.com", "license.paloaltonetworks.com",
    "autofocus.paloaltonetworks.com", "example.com", "test.com", "anon.internal", "corp.local", "pool.ntp.org", "ntp.org",
)
DOMAIN_STOPWORDS = (
    "local", "lan", "intra", "internal", "corp", "com", "net", "org", "edu", "gov", "ad", "ads", "dom", "domain", "int", "pri",
    "priv", "private", "home", "office",
)
RESERVED_TLDS = ("example", "test", "invalid", "localhost")
VOCABULARY_PREFIXES = ("pan_", "panw-", "pan-")
VOCABULARY_PARENTS = (
    "decoder", "application", "file-type", "dns-security-categories", "category", "threat-exception", "lists", "protocol",
    "signature", "botnet-domains", "config",
)
OBJECT_PARENTS = {
    "address": "addr", "address-group": "addr-grp", "service": "svc", "service-group": "svc-grp", "application-group": "app-grp",
    "application-filter": "app-filter", "schedule": "sched", "zone": "zone", "virtual-router": "vr", "interface": "intf",
    "gateway": "gw", "ike-gateway": "ike-gw", "tunnel": "tunnel", "crypto-profiles": "crypto", "ike-crypto-profile": "ike-crypto",
    "ipsec-crypto-profile": "ipsec-crypto", "authentication-profile": "auth-prof", "server-profile": "srv-prof",
    "authentication-sequence": "auth-seq", "mfa-vendor-type": "mfa", "admin": "admin", "user": "user", "user-group": "grp",
    "device-group": "dg", "template": "tmpl", "template-stack": "tmpl-stk", "log-forwarding": "log-fwd",
    "email-server": "mail-srv", "syslog-server": "syslog-srv", "snmp-trap": "snmp", "rules": "rule", "profiles": "prof",
    "qos-profile": "qos", "profile-group": "prof-grp", "portal": "gp-portal", "tunnel-interface": "tun-intf",
}
IDENTITY_PARENTS = (
    *OBJECT_PARENTS, "users", "certificate", "server", "ldap", "radius", "kerberos", "tacplus", "saml-idp", "local-user-database",
    "email", "syslog", "http", "snmptrap", "layer3", "units", "ethernet", "vlan", "aggregate-ethernet", "loopback",
    "ike-crypto-profiles", "ipsec-crypto-profiles", "ipsec", "vsys", "dynamic-user-group", "custom-url-category", "tag",
    "static-route", "bgp-peer", "peer", "peer-group", "dhcp", "reserved",
)
OBJECT_PREFIXES = {
    "addr": "ADDR", "addr-grp": "ADDR-GRP", "svc": "SVC", "svc-grp": "SVC-GRP", "app-grp": "APP-GRP", "zone": "ZONE", "vr": "VR",
    "intf": "INTF", "tun-intf": "TUN-INTF", "gw": "GW", "ike-gw": "IKE-GW", "tunnel": "TUNNEL", "auth-prof": "AUTH-PROF",
    "srv-prof": "SRV-PROF", "auth-seq": "AUTH-SEQ", "dg": "DG", "tmpl": "TMPL", "rule": "RULE", "qos": "QOS", "admin": "ADMIN",
    "user": "USR", "grp": "GRP", "gp-gw": "GP-GW", "gp-portal": "GP-PORTAL", "log-fwd": "LOG-FWD", "mail-srv": "MAIL-SRV",
}
FIELD_KINDS = {
    "common-name": "fqdn", "issuer": "cert", "subject": "cert", "domain": "domain", "base": "dn", "bind-dn": "dn", "address": "fqdn",
    "to": "email", "recipient-emails": "email", "hostname": "host", "devicename": "host", "contact": "person",
    "full-name": "person", "serial": "serial", "panorama-server": "fqdn", "ntp-server-address": "fqdn",
}
SYSTEM_INFO_KEYS = {"hostname": "host", "devicename": "host", "domain": "host", "serial": "serial"}

# What a policy scan looks for.
POLICY_TLDS = (
    "com", "net", "org", "fr", "io", "de", "uk", "eu", "ch", "be", "nl", "es", "ru", "cn", "biz", "cloud", "ovh", "xyz", "online", "site",
    "tech", "ai", "ca", "lu", "pt", "pl", "se", "dk", "fi", "ie", "jp", "kr", "br", "au", "nz", "edu", "gov", "mil", "local", "lan",
    "corp", "internal",
)
_ENDINGS = "|".join(POLICY_TLDS + RESERVED_TLDS)
POLICY_SUFFIX = rf"(?i)\.(?:{_ENDINGS})(?![{LETTER}-])"
POLICY_HOST = rf"(?i)(?<![{LETTER}.-])((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+(?:{_ENDINGS}))(?![{LETTER}-])"
POLICY_MAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
POLICY_SERIAL = r"(?<![0-9.])0[0-9]{11}(?![0-9.])"
POLICY_ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"
POLICY_ACCOUNT = rf"(?<![{LETTER}\\])[A-Za-z][A-Za-z0-9-]{{1,14}}\\{{1,2}}[A-Za-z][A-Za-z0-9._-]{{2,}}"
POLICY_SKIPPED_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".pdf", ".lock")
POLICY_SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv")
# End of fixed values.


def to_python(pattern: str) -> str:
    """The same pattern for Python's re, which has no property classes and spells the end of text differently."""
    return pattern.replace(LETTER, r"\w").replace(r"\z", r"\Z")
