"""A deterministic generator of diagnostic archives, for tests and demonstrations. All names are invented."""

from __future__ import annotations

import gzip
import io
import random
import tarfile

MTIME = 1_760_000_000
DEVICE, DOMAIN, SERIAL = "edge-fw-07", "harborline.example.org", "012345678901"
PEOPLE = ("m.okafor", "lena.brandt", "svc-backup2")
OBJECTS = ("Web-Front-01", "DB-Vault", "Branch-Lyon", "web server prod")


def configuration() -> str:
    objects = "".join(f'<entry name="{o}"><ip-netmask>10.20.{i}.{i + 5}</ip-netmask><description>rack {i} of {o}</description></entry>' for i, o in enumerate(OBJECTS))
    return f"""<?xml version="1.0"?>
<config><devices><entry name="localhost.localdomain"><deviceconfig><system><hostname>{DEVICE}</hostname><domain>{DOMAIN}</domain>
<serial>{SERIAL}</serial><contact>Lena Brandt</contact><login-banner>Property of Harborline
call the desk</login-banner></system></deviceconfig>
<network><interface><ethernet><entry name="ethernet1/1"><layer3><ip><entry name="10.20.0.1/24"/><entry name="172.16.4.1/30"/></ip></layer3></entry></ethernet></interface>
<virtual-router><entry name="core-vr"><routing-table><ip><static-route><entry name="default-out"><destination>0.0.0.0/0</destination><nexthop><ip-address>172.16.4.2</ip-address></nexthop></entry>
<entry name="branch"><destination>10.20.0.0/16</destination><nexthop><ip-address>10.20.0.9</ip-address></nexthop></entry></static-route></ip></routing-table></entry></virtual-router></network>
<vsys><entry name="vsys1"><address>{objects}</address></entry></vsys></entry></devices>
<shared><server-profile><ldap><entry name="Corp-LDAP"><base>DC=harborline,DC=example,DC=org</base><bind-dn>CN=bind,DC=harborline,DC=example,DC=org</bind-dn></entry></ldap>
<email><entry name="Mail-Out"><to>desk@{DOMAIN}</to></entry></email></server-profile>
<certificate><entry name="vpn.{DOMAIN}"><subject>CN=vpn.{DOMAIN}, O=Harborline</subject></entry></certificate></shared>
<predefined><application><entry name="Vendor-Thing"><description>vendor words stay</description></entry></application></predefined></config>
"""


def log_lines(rng: random.Random, lines: int) -> list[str]:
    def one(i: int) -> str:
        at = f"2025-10-{i % 28 + 1:02d} {i % 24:02d}:{i % 60:02d}:{(i * 7) % 60:02d}"
        ip = f"{rng.choice(['10.20', '172.16', '81.22', '195.8'])}.{rng.randint(0, 9)}.{rng.randint(1, 254)}"
        return rng.choice(
            [
                f"{at} [authd] authenticated for user '{rng.choice(PEOPLE)}' from {ip} port {rng.randint(1, 65535)}",
                f"{at} [authd] failed authentication for user 'error' from {ip}",
                f"{at} [rule] match {rng.choice(OBJECTS)} count {rng.randint(0, 999999)}",
                f"{at} [mail] to desk@{DOMAIN} via {ip}/32 ok",
                f"{at} [lease] hostname {DEVICE} serial {SERIAL} peer {ip}.",
            ]
        )

    return [one(i) for i in range(lines)]


def routing_text() -> str:
    return """> show system info
hostname: edge-fw-07
serial: 012345678901

> show routing route
destination nexthop flags
0.0.0.0/0 172.16.4.2 A S
10.20.0.0/24 0.0.0.0 A C
81.22.0.0/16 172.16.4.2 A B
81.22.3.0/24 172.16.4.2 A B

> show routing protocol bgp loc-rib
Prefix: 81.22.3.0/24
  Nexthop: 172.16.4.2
Prefix: 10.20.5.0/24
> show routing protocol ospf dumplsdb
10.20.8.0/24     type-3 (Summary)
> show clock
"""


def members(lines: int = 200, seed: int = 7) -> list[tuple[str, bytes]]:
    rng = random.Random(seed)
    log = "\n".join(log_lines(rng, lines)) + "\n"
    routed = "2025-10-01 add route 81.22.9.0/24 nexthop 172.16.4.2 interface ethernet1/1\n2025-10-02 delete route 81.22.9.0/24 nexthop 172.16.4.2\n"
    return [
        ("opt/saved-configs/running-config.xml", configuration().encode()),
        ("var/log/pan/system.log", log.encode() + b"odd byte \xe9 stays\r\n"),
        ("var/log/pan/system.log.1.gz", gzip.compress(log[: len(log) // 2].encode(), mtime=0)),
        ("var/log/pan/routed.log", routed.encode()),
        ("var/log/pan/rule-hits.bin", b"\x00\x01\x02" * 50 + b" DB-Vault 10.20.1.6 " + b"\x00\x03" * 50),
        ("var/log/pan/plain.txt", b"nothing here\nat all\n"),
        (f"tmp/cli/techsupport_{DEVICE}_20251001_1200.txt", routing_text().encode() + b'set address X description "only quoted"\n'),
        ("opt/ui/catalog.js.gz", gzip.compress(b"<description>never closed " * 200, mtime=0)),
    ]


def archive(lines: int = 200, seed: int = 7) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        folders: set[str] = set()
        for path, raw in members(lines, seed):
            for i in range(1, path.count("/") + 1):
                folder = "/".join(path.split("/")[:i])
                if folder not in folders:
                    folders.add(folder)
                    own = tarfile.TarInfo(folder)
                    own.type, own.mode, own.mtime = tarfile.DIRTYPE, 0o755, MTIME
                    tar.addfile(own)
            own = tarfile.TarInfo(path)
            own.size, own.mode, own.uid, own.gid, own.uname, own.gname, own.mtime = len(raw), 0 if path.endswith("bin") else 0o640, 1234, 1234, "pan", "pan", MTIME
            tar.addfile(own, io.BytesIO(raw))
    return out.getvalue()
