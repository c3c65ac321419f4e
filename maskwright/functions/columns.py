"""Column functions: detectors, IPv4 arithmetic, the prefix-preserving pseudonym, and rewriting of segments.

All stay inside the JVM. Lambdas evaluate only where a text has a match, so prose costs one pattern search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import fixed


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def valid_ipv4(ip: Column, strict: bool = False) -> Column:
    """Four parts of 0 to 255. strict: as an address library reads it, so without leading zeros."""
    fine = F.forall(F.split(ip, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    return fine & ~ip.rlike(r"(^|\.)0[0-9]") if strict else fine


def ipv4_found(text: Column) -> Column:
    """array<string>: the addresses of a text, in order, without their masks. A text without a dot is not searched."""
    return F.when(text.contains("."), F.filter(matches(text, fixed.IPV4, 1), lambda ip: valid_ipv4(ip))).otherwise(F.array().cast("array<string>"))


def emails_found(text: Column) -> Column:
    """array<string>, as written. A text without @ is not searched."""
    return F.when(text.contains("@"), matches(text, fixed.EMAIL)).otherwise(F.array().cast("array<string>"))


def marked(kind: str, values: Column) -> Column:
    """array<struct<kind, value>>."""
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def users_found(text: Column) -> Column:
    return F.when(text.contains("user"), matches(text, fixed.USER_PHRASE, 1)).otherwise(F.array().cast("array<string>"))


def hosts_found(text: Column) -> Column:
    """Values of host name phrases that look like a device name: a digit, dot or hyphen, no file suffix, no address."""
    named = F.filter(
        matches(text, fixed.HOSTNAME_PHRASE, 1),
        lambda v: v.rlike(r"[0-9.\-]") & ~v.rlike(fixed.FILE_SUFFIX) & ~v.rlike(fixed.IP_LIKE),
    )
    return F.when(text.contains("hostname"), named).otherwise(F.array().cast("array<string>"))


def serials_found(text: Column) -> Column:
    return matches(text, fixed.SERIAL, 1)


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null unless it has four numeric parts."""
    part = lambda i: F.get(F.split(ip, r"\."), F.lit(i)).try_cast("int").cast("long")
    return part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * (1 << 8) + part(3)


def ipv4_text(number: Column) -> Column:
    byte = lambda s: F.shiftrightunsigned(number, s).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def inside(number: Column, network: int, length: int) -> Column:
    return F.shiftrightunsigned(number, 32 - length) == F.lit(network >> (32 - length))


def network_of(number: Column, length: Column) -> Column:
    """The network address under a mask of that length, by arithmetic so that the length can be a column."""
    size = F.pow(F.lit(2.0), F.lit(32) - length).cast("long")
    return number - F.pmod(number, size)


def kept_ipv4(number: Column) -> Column:
    """Unspecified, loopback, link-local, multicast, reserved and mask addresses keep their value."""
    found = F.lit(False)
    for network, length in fixed.KEPT_CLASSES:
        found = found | inside(number, network, length)
    return found


def private_ipv4(number: Column) -> Column:
    found = F.lit(False)
    for network, length in fixed.TREE_CLASSES:
        found = found | inside(number, network, length)
    return found


_POWERS_OF_TWO = [1 << (31 - i) for i in range(32)]


def tree_pseudonym(number: Column, seed: Column) -> Column:
    """Prefix-preserving, one-to-one pseudonym of an address number.

    Private classes keep their class prefix and last octet; the first free bit always flips, the others up to bit 23
    by a keyed bit of the path to them. All other addresses go to 240.0.0.0/4: the top four bits lead the path, bits 4
    to 31 flip by keyed bits. So addresses that share a prefix share the pseudonym's prefix. The keyed bit is the last
    bit of SHA-256 over seed, head and path.
    """
    start, head, stop = F.lit(4), F.concat(F.lit("P"), F.shiftrightunsigned(number, 28).cast("string")), F.lit(32)
    base = F.lit(0xF0000000).cast("long")
    for network, length in fixed.TREE_CLASSES:
        own = inside(number, network, length)
        start, stop = F.when(own, length).otherwise(start), F.when(own, 24).otherwise(stop)
        head = F.when(own, str(length)).otherwise(head)
        base = F.when(own, F.lit(network).cast("long")).otherwise(base)
    node = F.struct(
        F.lpad(F.bin(number), 32, "0").alias("binary"), start.alias("start"), stop.alias("stop"), base.alias("base"), F.concat_ws(":", seed, head, F.lit("")).alias("path")
    )

    def walk(node: Column) -> Column:
        def add(total: Column, bit: Column) -> Column:
            real = F.substring(node["binary"], bit + 1, F.lit(1)).cast("long")
            path = F.concat(node["path"], F.substring(node["binary"], node["start"] + 1, bit - node["start"]))
            keyed = F.instr(F.lit("13579bdf"), F.right(F.sha2(path, 256), F.lit(1))) > 0
            flips = ((node["stop"] == 24) & (bit == node["start"])) | keyed
            new = F.when(bit >= node["stop"], real).otherwise(F.when(flips, 1 - real).otherwise(real))
            return total + F.when(new == 1, F.get(F.lit(_POWERS_OF_TWO).cast("array<bigint>"), bit)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(node["start"], F.lit(31)), node["base"], add)

    return bound(node, walk)


def pseudonym_ipv4(ip: Column, seed: Column) -> Column:
    """The address's pseudonym as text; an address that is kept, or that an address library rejects, as it is."""
    new = bound(ipv4_number(ip), lambda n: F.when(~kept_ipv4(n), bound(tree_pseudonym(n, seed), ipv4_text)))
    return F.when(valid_ipv4(ip, strict=True), F.coalesce(new, ip)).otherwise(ip)


def rewritten(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with every match replaced by change(match); a null change keeps the match."""
    gaps, found = F.split(text, pattern, -1), matches(text, pattern)
    parts = F.zip_with(gaps, found, lambda gap, own: F.concat(gap, F.coalesce(change(own), own, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def rewritten_ipv4(text: Column, seed: Column) -> Column:
    """The text with its addresses replaced; masks stay."""
    ip = lambda own: F.regexp_extract(own, "^[0-9.]+", 0)
    new = lambda own: F.when(valid_ipv4(ip(own)), F.concat(pseudonym_ipv4(ip(own), seed), F.regexp_extract(own, "/[0-9]+$", 0)))
    return F.when(text.contains("."), rewritten(text, fixed.IPV4, new)).otherwise(text)


def suffixes(name: Column) -> Column:
    """array<string>: a dotted name and its parents, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def under(name: Column, domains: tuple[str, ...]) -> Column:
    """Whether a dotted name is one of the domains or below one."""
    return F.arrays_overlap(suffixes(name), F.array(*map(F.lit, domains)))


def parent_domains(name: Column) -> Column:
    """array<string>: a host name and its parents of two labels and more, without generic, short or numeric first
    labels; a name with an empty label or a file suffix stands alone."""
    low = F.rtrim(F.lower(name), F.lit("."))
    whole = F.array(low)
    own = F.filter(
        F.slice(suffixes(low), 2, F.greatest(F.size(F.split(low, r"\.")) - 2, F.lit(0))),
        lambda p: ~F.substring_index(p, ".", 1).isin(*fixed.DOMAIN_STOPWORDS)
        & (F.length(F.substring_index(p, ".", 1)) >= 2)
        & ~F.substring_index(p, ".", 1).rlike("^[0-9]+$")
        & p.rlike("[a-z]"),
    )
    return F.when(low.rlike(r"\.\.|^\.") | name.rlike(fixed.FILE_SUFFIX), whole).otherwise(F.concat(whole, own))


def is_binary(content: Column) -> Column:
    """Whether bytes are a binary format, by their first 4,096: without NUL if over 30 % are control bytes; with NUL
    unless they are at most 2 % NUL, 5 % control and have 8 line ends. Empty content is text."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    size = F.length(head)
    nul, control, lines = (F.regexp_count(head, F.lit(p)) for p in (r"\x00", r"[\x01-\x08\x0E-\x1F\x7F]", r"\n"))
    text = (nul <= 0.02 * size) & (control <= 0.05 * size) & (lines >= 8)
    return (size > 0) & F.when(nul == 0, control > 0.30 * size).otherwise(~text)


def line_flags(before: Column, after: Column) -> Column:
    """array<boolean>: for each line number, whether the two texts differ there; a line on one side only differs."""
    return F.zip_with(F.split(before, "\n", -1), F.split(after, "\n", -1), lambda a, b: ~a.eqNullSafe(b))


def tag_names(markup: Column) -> Column:
    return matches(markup, r"<([a-zA-Z][a-zA-Z0-9-]*)", 1)


def timestamps_counted(text: Column) -> Column:
    return F.regexp_count(text, F.lit(fixed.TIMESTAMP))


def numbers_counted(text: Column) -> Column:
    return F.regexp_count(text, F.lit(fixed.NUMERIC_TOKEN))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def safe_file_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), 1, 200)


def without_archive_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"(\.tar\.gz|\.tgz|\.tar)$", "")
