"""Named queries on the driver's tables; plans.oracles has the SQL of the same names.

The seed is that of a demonstration on synthetic tables; a real run passes its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import columns as C
from maskwright.functions import fixed
from maskwright.operators import allocate, detect, report, topology
from maskwright.operators.numbering import numbered

SEED = "demonstration"
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows source, id, text of documents and pages."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")))


def document_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").contains("."))
    return docs.select("doc_id", F.explode(C.ipv4_found(F.col("text"))).alias("ip"))


def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").contains("@"))
    return docs.select("doc_id", F.posexplode(C.emails_found(F.col("text"))).alias("pos", "email"))


def n_rows() -> Column:
    return F.count("*").cast("long").alias("n")


def q01_detect_ipv4(spark, sf_dir):
    return document_ips(spark, sf_dir).groupBy("doc_id", "ip").agg(n_rows())


def q02_detect_email(spark, sf_dir):
    rows = texts(spark, sf_dir).filter(F.col("text").contains("@"))
    rows = rows.select("source", "id", F.explode(C.emails_found(F.col("text"))).alias("email"))
    return rows.groupBy("source", "id", F.lower("email").alias("email")).agg(n_rows())


def q03_identity_census(spark, sf_dir):
    found = {"ip": C.ipv4_found(F.col("text")), "email": F.transform(C.emails_found(F.col("text")), F.lower)}
    arrays = [C.marked(k, a) for k, a in found.items()]
    rows = texts(spark, sf_dir).select("source", "id", F.inline(F.concat(*arrays)))
    return rows.groupBy("source", "kind").agg(
        F.count("*").cast("long").alias("occurrences"), F.countDistinct("value").cast("long").alias("identities"), F.countDistinct("id").cast("long").alias("texts")
    )


def ip_class(number: Column) -> Column:
    return F.when(C.kept_ipv4(number), "kept").when(C.private_ipv4(number), "private").otherwise("public")


def q04_ip_classes(spark, sf_dir):
    rows = document_ips(spark, sf_dir)
    return rows.groupBy(ip_class(C.ipv4_number(F.col("ip"))).alias("class")).agg(n_rows(), F.countDistinct("ip").cast("long").alias("addresses"))


def ip_mapping(spark, sf_dir):
    ips = document_ips(spark, sf_dir).select("ip").distinct()
    mapped = ips.select("ip", C.pseudonym_ipv4(F.col("ip"), F.lit(SEED)).alias("fake"))
    return mapped.filter("ip <> fake")


def q05_ip_pseudonym(spark, sf_dir):
    return ip_mapping(spark, sf_dir)


def q06_email_pseudonym(spark, sf_dir):
    found = document_emails(spark, sf_dir).select(F.col("email").alias("value"), F.struct("doc_id", "pos").alias("seq"))
    hosts = allocate.map_hosts(found.select(F.substring_index(F.lower("value"), "@", -1).alias("value"), "seq"))
    return allocate.map_emails(found, hosts).select(F.col("original").alias("email"), F.col("pseudonym").alias("fake"))


def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.url_host(F.col("url")).alias("host")).filter("host <> ''")


def q07_host_parents(spark, sf_dir):
    hosts = page_hosts(spark, sf_dir).select("host").distinct()
    rows = hosts.select("host", F.explode(C.parent_domains(F.col("host"))).alias("domain"))
    return rows.withColumn("kept", allocate.kept_host(F.col("domain")))


def q08_host_pseudonym(spark, sf_dir):
    hosts = page_hosts(spark, sf_dir).select(F.col("host").alias("value"), F.col("page_id").alias("seq"))
    return allocate.map_hosts(hosts).select(F.col("original").alias("host"), F.col("pseudonym").alias("fake"))


def objects(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), F.lit("user").alias("kind"), (F.col("c_custkey") * 2).alias("seq"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("value"), F.lit("grp").alias("kind"), (F.col("s_suppkey") * 2 + 1).alias("seq"))
    return customers.unionByName(suppliers)


def q09_object_pseudonym(spark, sf_dir):
    return allocate.map_objects(objects(spark, sf_dir)).select("original", "pseudonym")


def q10_seeded_resume(spark, sf_dir):
    every = objects(spark, sf_dir)
    seed = allocate.map_objects(every.filter("seq % 3 = 0"))
    return allocate.map_objects(every, seed=seed).select("original", "pseudonym")


def q11_duplicates_collisions(spark, sf_dir):
    ips = document_ips(spark, sf_dir).select("ip").distinct()
    naive = ips.select(F.col("ip").alias("original"), F.concat(F.substring_index("ip", ".", 1), F.lit(".0.0.1")).alias("pseudonym"))
    extra = naive.select(F.col("pseudonym").alias("original"), F.lit("240.0.0.1").alias("pseudonym")).distinct()
    mapping = naive.unionByName(extra).distinct()
    dup = allocate.duplicates(mapping).select(F.lit("duplicate").alias("kind"), F.col("pseudonym").alias("value"), F.col("n").cast("long").alias("n"))
    return dup.unionByName(allocate.collisions(mapping).select(F.lit("collision").alias("kind"), F.col("original").alias("value"), F.lit(1).cast("long").alias("n")))


def rewritten_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("new", C.rewritten_ipv4(F.col("text"), F.lit(SEED)))


def q12_rewrite_ip_text(spark, sf_dir):
    return rewritten_documents(spark, sf_dir).select("doc_id", F.md5("new").alias("digest"))


def q13_replacement_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ips = F.size(F.filter(C.ipv4_found(F.col("text")), lambda ip: C.pseudonym_ipv4(ip, F.lit(SEED)) != ip))
    rows = docs.select("doc_id", F.explode(F.create_map(F.lit("ip_addresses"), ips, F.lit("emails"), F.size(C.emails_found(F.col("text"))))).alias("class", "n"))
    return rows.filter("n > 0").select("doc_id", "class", F.col("n").cast("long").alias("n"))


def q14_leak_scan(spark, sf_dir):
    keys = ip_mapping(spark, sf_dir).select(F.col("ip").alias("key"))
    keys = keys.unionByName(document_emails(spark, sf_dir).select(F.lower("email").alias("key")).distinct())
    out = rewritten_documents(spark, sf_dir).select("doc_id", F.explode(F.concat(C.ipv4_found(F.col("new")), F.transform(C.emails_found(F.col("new")), F.lower))).alias("key"))
    return out.join(keys, "key", "left_semi").groupBy("key").agg(n_rows())


def q15_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("n"), F.md5("line").alias("digest"))


def changed_counts(spark, sf_dir):
    flags = C.line_flags(F.col("text"), F.col("new"))
    rows = rewritten_documents(spark, sf_dir).withColumn("flags", flags)
    changed = F.size(F.filter("flags", lambda c: c)).cast("long")
    return rows.select("doc_id", "lang", "new", changed.alias("changed"), F.size("flags").cast("long").alias("lines"))


def q16_changed_lines(spark, sf_dir):
    return changed_counts(spark, sf_dir).select("doc_id", "changed", (F.col("lines") - F.col("changed")).alias("unchanged"))


def q17_numeric_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.numbers_counted(F.col("html")).cast("long").alias("n"))


def q18_timestamps(spark, sf_dir):
    rows = texts(spark, sf_dir).select("source", "text")
    events = table(spark, sf_dir, "events").select(F.lit("events").alias("source"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))
    rows = rows.unionByName(events)
    return rows.groupBy("source").agg(n_rows(), F.coalesce(F.sum(C.timestamps_counted(F.col("text"))), F.lit(0)).cast("long").alias("stamps"))


def q19_tag_sequence(spark, sf_dir):
    tags = C.tag_names(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(tags).cast("long").alias("n"), F.md5(F.array_join(tags, ",")).alias("digest"))


def q20_free_text(spark, sf_dir):
    from maskwright.operators.freetext import redacted_column

    rows = redacted_column(table(spark, sf_dir, "pages").select("page_id", "html"), "html", tags=("title", "h1"))
    return rows.select("page_id", F.md5("html").alias("digest"), F.col("n_redacted").cast("long").alias("n"))


def q21_binary_heuristic(spark, sf_dir):
    whole = F.col("text")
    some = F.translate(whole, "et", "\x01\x02")
    versions = F.create_map(F.lit("plain"), whole, F.lit("some"), some, F.lit("many"), F.translate(whole, "aeioutrn", "\x01\x02\x03\x04\x05\x06\x07\x08"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(versions).alias("version", "text"))
    return rows.select("doc_id", "version", C.is_binary(F.encode("text", "UTF-8")).alias("binary"))


def q22_referential_join(spark, sf_dir):
    fake = lambda c: F.sha2(F.concat_ws(":", F.lit(SEED), F.col(c).cast("string")), 256)
    orders = table(spark, sf_dir, "orders").select(fake("o_custkey").alias("fake"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(fake("c_custkey").alias("own"), "c_mktsegment")
    rows = orders.join(customers, F.col("fake") == F.col("own")).groupBy(F.col("c_mktsegment").alias("segment"))
    return rows.agg(n_rows(), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def q23_member_diff(spark, sf_dir):
    before = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), "n_name", F.col("n_regionkey").cast("long").alias("region"))
    after = before.filter("key % 7 <> 3").withColumn("n_name", F.when(F.col("key") % 5 == 2, F.lower("n_name")).otherwise(F.col("n_name")))
    after = after.unionByName(before.filter("key % 6 = 0").withColumn("key", F.col("key") + 100))
    return report.member_differences(before, after, "key", ("n_name", "region"))


def q24_slash24_groups(spark, sf_dir):
    rows = ip_mapping(spark, sf_dir)
    net = lambda c: F.substring_index(c, ".", 3)
    return rows.groupBy(ip_class(C.ipv4_number(F.col("ip"))).alias("class")).agg(
        n_rows(), F.countDistinct(net("ip")).cast("long").alias("nets"), F.countDistinct(net("fake")).cast("long").alias("fake_nets")
    )


def q25_containment(spark, sf_dir):
    ips = document_ips(spark, sf_dir).select(C.ipv4_number(F.col("ip")).alias("number")).distinct()
    nets = ips.select("number", F.explode(F.array(*[F.lit(p) for p in (8, 12, 16, 24, 32)])).alias("plen"))
    nets = nets.select(C.network_of(F.col("number"), F.col("plen")).alias("net"), "plen").distinct()
    nets = nets.withColumn("idx", F.concat(C.ipv4_text(F.col("net")), F.lit("/"), F.col("plen").cast("string")))
    return topology.containment(nets)


def file_report(spark, sf_dir):
    leaks = F.size(F.filter(C.emails_found(F.col("new")), lambda e: e.isNotNull())).cast("long")
    rows = changed_counts(spark, sf_dir).withColumn("leaks", leaks)
    status = F.when(F.col("leaks") > 0, "error").when(F.col("changed") > 0, "anonymized").otherwise("identical")
    return rows.select("doc_id", "lang", "changed", "leaks", status.alias("status"))


def q26_status_summary(spark, sf_dir):
    return report.status_summary(file_report(spark, sf_dir))


def q27_report_page(spark, sf_dir):
    rows = report.page(file_report(spark, sf_dir), ("identical", "anonymized"), "E", 5, 40, "doc_id", "lang")
    return rows.select("doc_id", "lang", "status", F.col("total").cast("long").alias("total"))


def q28_top_leaks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(F.concat(C.ipv4_found(F.col("text")), F.transform(C.emails_found(F.col("text")), F.lower))).alias("key"))
    return rows.groupBy("key").agg(n_rows()).orderBy(F.desc("n"), "key").limit(50)


def q29_diff_hunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    lines = docs.select("doc_id", F.size("lines").alias("total"), F.posexplode("lines").alias("at", "line"))
    lines = lines.select("doc_id", "total", (F.col("at") + 1).alias("n"), F.col("line").rlike("[0-9#&]").alias("changed"))
    return report.hunks(lines, "doc_id").select("doc_id", F.col("hunk").cast("long").alias("hunk"), "start", "end")


def q30_phase_durations(spark, sf_dir):
    return report.time_in_phase(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "micros")


def q31_latest_in_group(spark, sf_dir):
    return report.latest(table(spark, sf_dir, "events"), "user_id", "event_id", "ts")


def chains(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", before.alias("seed_from"))


def q32_chain_walk(spark, sf_dir):
    return report.nearest_ancestor(chains(spark, sf_dir), "event_id", "seed_from", F.col("event_type") == "purchase")


def q33_stopwords(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.explode(C.matches(F.lower("text"), "[a-z]+")).alias("token"))
    rows = docs.groupBy("token").agg(n_rows())
    return allocate.without(rows, F.col("token"), fixed.USER_STOPWORDS + fixed.BUILTIN_NAMES + fixed.DOMAIN_STOPWORDS)


def q34_policy_scan(spark, sf_dir):
    rows = texts(spark, sf_dir).select(F.struct("source", "id").alias("key"), "text")
    found = detect.policy_findings(rows, "key", "text", ("example.com",))
    return found.select("id.source", "id.id", "kind", "value", F.col("n").cast("long").alias("n"))


def q35_numbered_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return numbered(rows, ("event_type", "event_id"), "number")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}
