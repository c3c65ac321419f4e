"""The registered format and functions, and the command line."""

import json

from maskwright import cli
from maskwright.sources import archive, datasource, mock


def test_format_equals_reader(spark, tmp_path):
    (tmp_path / "a.tgz").write_bytes(mock.archive(50, 1))
    (tmp_path / "b.tgz").write_bytes(mock.archive(50, 2))
    datasource.register(spark)
    one = spark.read.format("tararchive").load(f"{tmp_path}/*.tgz")
    two = archive.read_archives(spark, f"{tmp_path}/*.tgz")
    key = ["seq", "path", "type", "mode", "size", "payload", "kind"]
    assert sorted(map(repr, one.select(*key).collect())) == sorted(map(repr, two.select(*key).collect()))
    bare = spark.read.format("tararchive").option("payload", "false").load(f"{tmp_path}/a.tgz")
    assert bare.filter("payload is not null").count() == 0 and bare.count() == one.filter("archive like '%a.tgz'").count()


def test_unsafe_members_are_left_out():
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, kind in (("ok/x", tarfile.REGTYPE), ("../up", tarfile.REGTYPE), ("/abs", tarfile.REGTYPE), ("link", tarfile.SYMTYPE)):
            own = tarfile.TarInfo(name)
            own.type = kind
            tar.addfile(own, io.BytesIO(b""))
    assert [m["path"] for m in archive.members_of("t", out.getvalue())] == ["ok/x", "abs"]


def test_table_functions(spark):
    datasource.register(spark)
    spark.createDataFrame([(1, mock.configuration().partition("?>")[2]), (2, "<a><b/>"), (3, None)], "i int, d string").createOrReplaceTempView("docs")
    rows = spark.sql("SELECT i, f.kind, f.value FROM docs, LATERAL xml_identities(d) f").collect()
    assert (1, "obj", "DB-Vault") in [tuple(r) for r in rows] and [r["kind"] for r in rows if r["i"] == 2] == ["warning"]
    assert spark.sql("SELECT count(*) FROM docs, LATERAL xml_tags(d) t WHERE i > 1").first()[0] == 0


def test_command_line(spark, tmp_path, capsys):
    box, out = f"{tmp_path}/box.tgz", f"{tmp_path}/box_anon.tgz"
    assert cli.main(["mock", box, "--lines", "60"]) == 0
    assert cli.main(["anonymise", box, "--verify"]) == 0
    sidecar = json.loads((tmp_path / "box_anon.mapping.json").read_text())
    assert sidecar["redact_free_text"] and len(sidecar["ip_seed"]) == 32 and sidecar["emails"]
    assert cli.main(["compare", box, out, "--mapping", f"{tmp_path}/box_anon.mapping.json", "--report", f"{tmp_path}/report"]) == 0
    assert cli.main(["compare", box, box, "--mapping", f"{tmp_path}/box_anon.mapping.json"]) == 2
    capsys.readouterr()
    assert cli.main(["anonymise", box, "--output", f"{tmp_path}/second.tgz", "--seed-mapping", f"{tmp_path}/box_anon.mapping.json", "--mapping-only"]) == 0
    assert json.loads((tmp_path / "second.mapping.json").read_text()) == sidecar
