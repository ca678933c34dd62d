import io
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from bytelore.functions import findings as fd
from bytelore.functions import magic, payloads, portable, types
from bytelore.operators import archives, assess, detect, rank, views
from bytelore.plans.made import compound, zipped
from bytelore.sources import blob

TEXTS = {
    "rtf": "{\\rtf1 x}", "json": '{"a": 1, "b": [2]}', "ndjson": '{"a":1}\n{"b":2}\n', "xml": '<?xml version="1.0"?><a/>', "html": "<!DOCTYPE html><html></html>", "csv": "a,b,c\n1,2,3\n", "tsv": "a\tb\n1\t2\n",
    "ini": "; c\n[main]\nkey=1\n", "yml": "---\nname: x\nother: y\n", "log": "2024-01-02 10:00:00 INFO a\n2024-01-02 10:00:01 WARN b\n2024-01-02 10:00:02 ERROR c", "md": "# Title\n\n[a](b)\n", "ps1": "param([string]$x)\nGet-ChildItem -Path $x",
    "sh": "#!/bin/bash\necho x", "bat": "@echo off\r\ngoto end", "py": "#!/usr/bin/python\nprint(1)", "vbs": "Option Explicit\nDim x", "js": "const f = (a) => { return a; }", "asc": "-----BEGIN PGP MESSAGE-----\nx", "key": "-----BEGIN RSA PRIVATE KEY-----\nx",
    "txt": "just some words in a row", "eml": "From: a\nTo: b\nSubject: c\n\nbody",
}


def test_text_types(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "want string, text string")
    for x in detect.classify_text(docs).collect():
        assert x["extension"] == x["want"], x
    odd = spark.createDataFrame([(None,), ("",), ("  \n",), ("ab",), ("\x00\x01\x02\x03" * 20,)], "text string")
    assert {x["extension"] for x in detect.classify_text(odd).collect()} == {None}


@pytest.mark.parametrize("text,wrong", [("[INFO] started\n[WARN] late\n", "json"), ("C:\\a\\b: failed\nC:\\a\\c: failed\n", "yml"), ("[int]$x = 1\n$y = Get-Item x", "ini")])
def test_near_misses(spark, text, wrong):
    assert detect.classify_text(spark.createDataFrame([(text,)], "text string")).first()["extension"] != wrong


def _rows(spark, pairs):
    return blob.column(spark.createDataFrame([(str(i), b) for i, (b, _) in enumerate(pairs)], "id string, content binary"), "id", "content")


def test_every_header_is_known(spark):
    made = []
    for r in magic.RULES:
        for test in r.tests:
            body = bytearray(max(magic.HEADER, 1))
            for o, h in test:
                body[o : o + len(h) // 2] = bytes.fromhex(h)
            made.append((bytes(body), r.ext))
    found = detect.detect(_rows(spark, made)).collect()
    by = {x["id"]: x["extension"] for x in found}
    wrong = [(made[int(i)][1], e) for i, e in by.items() if made[int(i)][1] != e]
    assert set(wrong) <= {("tar", None), ("heic", "cur"), ("heic", "ico")}, wrong


def test_bytes_and_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x" * 20)
    (tmp_path / "b.log").write_text("plain words of a line\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.PS1").write_text("Write-Host 'x'\nparam($a)\n")
    (tmp_path / "empty").write_bytes(b"")
    found = {x["name"]: x for x in detect.detect(blob.files(spark, str(tmp_path))).collect()}
    assert (found["a.bin"]["extension"], found["a.bin"]["kind"]) == ("png", "Image") and found["b.log"]["extension"] == "log"
    assert found["c.PS1"]["extension"] == "ps1" and found["c.PS1"]["is_dangerous"] and "empty" not in found  # the file source has no row for an empty file
    assert blob.files(spark, str(tmp_path), glob="*.log").count() == 1 and blob.files(spark, str(tmp_path), max_bytes=24).count() == 1


def test_names_kinds_and_families(spark):
    rows = spark.createDataFrame([(" .TXT ",), ("exe",), ("",), (None,)], "e string").select(types.normalise_extension(F.col("e")).alias("n"), types.is_dangerous(F.col("e")).alias("d")).collect()
    assert [(x["n"], x["d"]) for x in rows] == [("txt", False), ("exe", True), (None, False), (None, False)]
    pairs = [("cer", "crt", True), ("admx", "xml", True), ("exe", "dll", True), ("pdf", "exe", False), ("txt", "txt", True), ("xml", "admx", False)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").withColumn("ok", F.expr(types.agrees_sql("a", "b"))).collect()
    assert all(x["ok"] == x["want"] for x in got)


def test_findings(spark):
    text = "iex (x)\ncertutil -decode a b\nnet use z: \\\\srv\\share\nhttp://a.corp.example/x https://cdn.example.org\nexec(b64decode('x'))"
    row = spark.createDataFrame([(text,)], "t string").select(fd.script_findings(F.col("t"), F.lit("ps1")).alias("s"), fd.network_findings(F.col("t"), ["*.corp.example"]).alias("n")).first()
    assert row["s"] == ["ps:iex", "py:exec-b64", "bat:certutil", "script:dangerous-kind"]
    assert row["n"] == ["net:unc=1", "net:map=1", "net:hosts=3", "net:hosts-int=1", "net:hosts-ext=2"]


def test_secrets(spark):
    cases = [
        ("key=A1b2C3d4E5f6G7h8I9j0", (0, 1, 0)), ("key=aaaaaaaaaaaaaaaaaaaaaaaa", (0, 0, 0)), ("password=example_placeholder_value_1", (0, 0, 0)), ("-----BEGIN EC PRIVATE KEY-----", (1, 0, 0)),
        ("x ghp_" + "a1B2" * 9 + " y", (0, 0, 1)), ("xghp_" + "a1B2" * 9, (0, 0, 0)), (None, (None, None, None)),
    ]
    t = F.col("t")
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, t string").select("i", fd.private_keys(t).alias("p"), fd.key_patterns(t).alias("k"), fd.tokens(t, "github").alias("g")).orderBy("i").collect()
    for x, (_, want) in zip(rows, cases, strict=True):
        if want[0] is not None:
            assert (x["p"], x["k"], x["g"]) == want, cases[x["i"]]
    assert spark.range(1).select(fd.redact(F.lit("abcdefghijkl")).alias("r")).first()["r"] == "abcd****ijkl"


def test_signatures_and_connection_strings(spark):
    sas, other = ("?sv=2022-11-02&sp=r&se=2030-01-01&sig=" + x * 6 + "%3D" for x in ("aB3d", "zY9w"))
    cases = [
        (f"token: https://a.blob.core.windows.net/c{sas}", (0, 1)), (f"see https://a.blob.core.windows.net/c{sas}", (0, 0)), (f"secret '{sas}' '{sas}' \"{other}\".", (0, 1)), (f"secret '{sas}' key='{other}'.", (0, 2)),
        (f"token {sas[:40]}", (0, 0)), (f"token {sas.replace('sv=', 'v=')}", (0, 0)), (f"token your_{sas}", (0, 0)), (f"token {'-' * 80} {sas}", (0, 0)),
        (f"{sas} {'-' * 50} bearer", (0, 1)), ("ConnectionString=Server=a;Password=b;", (1, 0)), ("connectionstring=Server=a;\nUser=b;PWD=c", (1, 0)), ("connectionstring=Server=a;", (0, 0)),
        ("connectionstring=" + "x" * 250 + "pwd=b", (0, 0)), ("connectionstring=connectionstring=pwd=a", (2, 0)), ("", (0, 0)),
    ]
    t = F.col("t")
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, t string").select("i", fd.key_patterns(t).alias("k"), fd.azure_sas(t).alias("a")).orderBy("i").collect()
    assert [(x["k"], x["a"]) for x in rows] == [want for _, want in cases]


def test_assessment(spark):
    judge = lambda findings: spark.createDataFrame([(findings,)], "f array<string>").select(assess.assess(assess.finding_factors(F.col("f"))).alias("a")).first()["a"]
    a = judge(["secret:jwt", "secret:keypattern", "secret:token"])
    assert (a["score"], a["decision"], a["decision_strict"], a["decision_lenient"]) == (70, "Block", "Block", "Warn")
    assert judge(["secret:token", "secret:token:slack"])["codes"] == ["Secret.TokenFamily.Slack"]
    assert judge(["ps:iex", "ps:iex", "net:unc=4"])["score"] == 25 and judge([])["decision"] == "Allow"
    made = spark.createDataFrame([([("a", 10), ("b", -15), ("c", 20)],)], "f array<struct<code:string,weight:int>>")
    row = made.select(assess.score(F.col("f")).alias("s"), assess.top_drivers(F.col("f")).alias("t")).first()
    assert row["s"] == 20 and row["t"] == ["c", "b", "a"]
    volume = spark.range(1).select(assess.volume_factors({"Secret.JWT": F.lit(4)}, F.array(F.lit("Secret.JWT"))).alias("v")).first()["v"]
    assert [(x["code"], x["weight"]) for x in volume] == [("Secret.JWT.Volume", 12)]


def test_ranking(spark):
    c = F.array(rank.candidate("log", "Low", 6), rank.candidate("json", "Medium"), rank.candidate("log", "Low", 9), rank.candidate("csv", "Medium"))
    row = spark.range(1).select(rank.ranked(c, F.lit("csv")).alias("r")).select("r", rank.choose(F.lit("txt"), F.col("r"), F.lit("json")).alias("c"), rank.choose(F.lit("csv"), F.col("r"), F.lit("")).alias("k"), rank.alternatives(F.col("r"), F.lit("csv")).alias("a")).first()
    assert [(x["ext"], x["score"]) for x in row["r"]] == [("csv", 73), ("json", 70), ("log", 59)] and row["k"] == "csv" and [x["ext"] for x in row["a"]] == ["json", "log"]


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in entries.items():
            z.writestr(n, b)
    return out.getvalue()


def test_archives(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for n, b in {"../evil.sh": b"x", "a/b.exe": b"MZ.."}.items():
            info = tarfile.TarInfo(n)
            info.size = len(b)
            t.addfile(info, io.BytesIO(b))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    rows = [("zip", _zip({"[Content_Types].xml": "x", "word/document.xml": "x", "word/vbaProject.bin": "x", "run.ps1": "x", "pic.jpg": b"MZ\x90\x00"})), ("tar", tar.getvalue()), ("broken", b"PK\x03\x04rubbish"), ("text", b"hello"), ("none", None)]
    out = archives.with_entries(spark.createDataFrame(rows, "id string, content binary")).withColumn("f", archives.archive_facts(F.col("entries")))
    by = {x["id"]: x for x in out.collect()}
    z, t = by["zip"]["f"], by["tar"]["f"]
    assert z["subtype"] == "docx" and set(z["flags"]) == {"contains_scripts", "disguised_executables", "ooxml_macros"} and z["entry_count"] == 5
    assert set(t["flags"]) == {"archive_path_traversal", "archive_symlinks", "contains_executables", "contains_scripts"} and t["top_extensions"] == ["exe:1", "sh:1"]
    assert by["broken"]["entries"] is None and by["text"]["entries"] is None and by["none"]["entries"] is None


def test_tar_safety_beyond_the_listed_entries(spark):
    def made(*last):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
            for i in range(archives.MAX_TAR_ENTRIES + 88):
                t.addfile(tarfile.TarInfo(f"d/{i}.txt"))
            for name, kind in last:
                info = tarfile.TarInfo(name)
                info.type = kind
                t.addfile(info)
        return out.getvalue()

    back = bytearray(made())
    back[124:136] = b"-0000002000\0"  # a size that leads back must not be walked for ever
    rows = [("clean", made()), ("up", made(("../x", tarfile.REGTYPE))), ("root", made(("/etc/x", tarfile.REGTYPE))), ("link", made(("l", tarfile.SYMTYPE))), ("back", bytes(back))]
    out = archives.with_entries(spark.createDataFrame(rows, "id string, content binary"))
    by = {x["id"]: x["f"] for x in out.select("id", archives.archive_facts(F.col("entries")).alias("f")).collect()}
    assert {k: set(f["flags"]) for k, f in by.items()} == {
        "clean": set(), "up": {"archive_path_traversal"}, "root": {"archive_path_traversal", "archive_absolute_paths"}, "link": {"archive_symlinks"}, "back": set()}
    assert by["up"]["entry_count"] == archives.MAX_TAR_ENTRIES and by["back"]["entry_count"] == 0


def test_portable_executables(spark):
    head = bytearray(1024)
    head[0:2], head[0x3C:0x40] = b"MZ", struct.pack("<I", 0x80)
    head[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<HH", head, 0x84, 0x8664, 3)
    struct.pack_into("<H", head, 0x80 + 22, 0x2000)
    struct.pack_into("<H", head, 0x80 + 24, 0x20B)
    struct.pack_into("<HH", head, 0x80 + 24 + 68, 2, 0x140)
    struct.pack_into("<I", head, 0x80 + 24 + 112 + 8 * 14, 0x2000)
    rows = spark.createDataFrame([(bytes(head),), (b"MZ",), (b"",), (None,)], "c binary").select(portable.portable_facts(F.col("c")).alias("f")).collect()
    f = rows[0]["f"]
    assert (f["machine"], f["subsystem"], f["extension"], f["is_dotnet"], f["has_signature"], f["sections"], f["flags"]) == ("x64", "gui", "dll", True, False, 3, ["pe_no_cfg"])
    assert [x["f"] for x in rows[1:]] == [None] * 3


def test_payloads(spark):
    import base64 as b64

    body = b"MZ" + bytes(range(200))
    rows = [("b64", "x " + b64.urlsafe_b64encode(body).decode()), ("hex", body.hex()), ("b85", b64.a85encode(body, adobe=True).decode()), ("qp", "a=3Db"), ("short", "abcd")]
    df = spark.createDataFrame(rows, "k string, t string")
    got = {x["k"]: x for x in df.select("k", payloads.base64_payload(F.col("t")).alias("b"), payloads.hex_payload(F.col("t")).alias("h"), payloads.other_payload("t", "k").alias("o")).collect()}
    assert bytes(got["b64"]["b"]) == body and bytes(got["hex"]["h"]) == body and bytes(got["b85"]["o"]) == body and bytes(got["qp"]["o"]) == b"a=b" and got["short"]["b"] is None
    checks = [('{"a":1}', "passed", "failed"), ('{"a":1} x', "failed", "failed"), ("[1,2,]", "failed", "failed"), ('{"a":1,"a":2}', "passed", "failed"), ("<a><b/></a>", "failed", "passed"), ("<!DOCTYPE a><a/>", "failed", "failed"), ("<a>", "failed", "failed")]
    for x in spark.createDataFrame(checks, "t string, j string, x string").select("j", "x", payloads.json_status("t").alias("gj"), payloads.xml_status("t").alias("gx")).collect():
        assert (x["gj"], x["gx"]) == (x["j"], x["x"])
    assert spark.range(1).select(payloads.xml_root(F.lit('<?xml version="1.0"?><!-- x --><p:policyDefinitions a="b">')).alias("r")).first()["r"] == "policyDefinitions"


def test_views(spark):
    judged = spark.createDataFrame([(1, ["ps:iex", "odd", "net:unc=2"]), (2, [])], "id int, f array<string>")
    rows = views.finding_rows(judged, "id", "f").orderBy("code").collect()
    assert [(x["code"], x["short"]) for x in rows] == [("net:unc=2", None), ("odd", None), ("ps:iex", "Evaluates text")]
    one = judged.where("id = 1").select(views.humanised(F.col("f"), 2).alias("h"), views.report_map({"a": F.lit(1), "b": F.lit(None)}).alias("m"), views.markdown(F.lit("T"), {"x": F.lit("y"), "z": F.lit("")}).alias("d"), views.labelled(F.lit("docx")).alias("l")).first()
    assert (one["h"], one["m"], one["d"], one["l"]) == ("Evaluates text, odd (+1 more)", {"a": "1"}, "# T\n\n- **x**: y", "Word document")


def test_stream(spark, tmp_path):
    from bytelore.streaming.detect import detect_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"a": 1}')
    for n in (1, 2):
        detect_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (src / "b.csv").write_text("a,b\n1,2\n")


def _zip_of(*names, mimetype=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if mimetype:
            z.writestr("mimetype", mimetype)
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


def _pe(characteristics, subsystem):
    body = bytearray(512)
    body[:2], body[0x3C:0x40], body[0x40:0x44] = b"MZ", struct.pack("<I", 0x40), b"PE\0\0"
    struct.pack_into("<HH", body, 0x44, 0x14C, 1)
    struct.pack_into("<H", body, 0x40 + 22, characteristics)
    struct.pack_into("<H", body, 0x40 + 24, 0x10B)
    struct.pack_into("<H", body, 0x40 + 24 + 68, subsystem)
    return bytes(body)


def _disk(*marks):
    body = bytearray(b"\0" * (2048 * 20))
    for at, mark in marks:
        body[at : at + len(mark)] = mark
    return bytes(body)


OLE = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 504


def test_contents_tell_more_than_headers(spark):
    words = "plain words in a row of a line"
    sector = lambda i: (16 + i) * 2048 + 1
    made = [
        (_pe(0x2002, 2), "dll", "High"), (_pe(0x2, 1), "sys", "High"), (_pe(0x2, 3), "exe", "High"),
        (_zip_of("[Content_Types].xml", "word/document.xml"), "docx", "High"), (_zip_of("[Content_Types].xml", "xl/workbook.xml"), "xlsx", "High"), (_zip_of("[Content_Types].xml", "ppt/presentation.xml"), "pptx", "High"),
        (_zip_of("a.txt", "word/document.xml"), "zip", "High"), (_zip_of("x/META-INF/MANIFEST.MF"), "zip", "High"), (_zip_of("META-INF/MANIFEST.MF"), "jar", "High"), (_zip_of("META-INF/MANIFEST.MF", "classes.dex"), "apk", "High"),
        (_zip_of("Payload/a.app/Info.plist"), "ipa", "High"), (_zip_of("AppxManifest.xml"), "appx", "High"), (_zip_of("AppxManifest.xml", "AppxSignature.p7x"), "msix", "High"),
        (_zip_of("content.opf", mimetype="application/epub+zip"), "epub", "High"), (_zip_of("content.xml", mimetype="application/vnd.oasis.opendocument.spreadsheet"), "ods", "High"),
        (_zip_of("doc.kml"), "kmz", "High"), (_zip_of("extension.vsixmanifest"), "vsix", "High"), (_zip_of("AppManifest.xaml"), "xap", "High"), (_zip_of("Pkg.NuSpec"), "nupkg", "High"),
        (compound({"WordDocument": b"x"}), "doc", "Medium"), (compound({"workbook": b"x"}), "xls", "Medium"), (compound({"PowerPoint Document": b"x"}), "ppt", "Medium"), (OLE, "ole2", "High"),
        (compound({"\5SummaryInformation": b"", "Property": b"", "Media": b"", "Component": b""}), "msi", "High"), (compound({"\5SummaryInformation": b"", "Property": b"", "Media": b""}), "msi", "Medium"),
        (OLE + "WordDocument".encode("utf-16-le"), "ole2", "High"), (compound({"Contents": b"WordDocument Workbook"}), "ole2", "High"), (compound({"__substg1.0_001A001F": b""}), "msg", "Medium"),
        (_zip_of("a.txt") + b"", "zip", "High"), (zipped({"a.docx": _zip_of("[Content_Types].xml", "word/document.xml")}), "zip", "High"), (zipped({"a.jar": _zip_of("META-INF/MANIFEST.MF")}), "zip", "High"),
        (b'{"asset": {"version": "2.0"}, "nodes": []}', "gltf", "Medium"),
        (_disk((0x8001, b"CD001")), "iso", "High"), (_disk((sector(0), b"BEA01"), (sector(1), b"NSR02"), (sector(2), b"TEA01")), "udf", "High"), (_disk((sector(1), b"NSR03"), (0x8001, b"CD001")), "udf", "Medium"),
        (b"\1" * 600 + b"koly" + b"\1" * 508, "dmg", "Medium"),
        (b"\xff\xfe" + words.encode("utf-16-le"), "txt", None), (b"\xfe\xff" + words.encode("utf-16-be"), "txt", None), (words.encode("utf-16-le"), "txt", None), (words.encode("utf-16-be"), "txt", None), (b"\xef\xbb\xbf" + words.encode(), "txt", None),
        (b"\xff\xfe" + (words * 100 + "\U0001f600" * 999).encode("utf-16-le") + b"\x00\xd8", "txt", None),
        ("привет мир ".encode() * 600, "txt", None), ("aпривет мир ".encode() * 600, "txt", None), (b"", None, None), (b"\x00\x01", None, None),
    ]
    found = {int(x["id"]): x for x in detect.detect(_rows(spark, [(b, None) for b, _, _ in made])).collect()}
    for i, (body, ext, confidence) in enumerate(made):
        assert found[i]["extension"] == ext and confidence in (None, found[i]["confidence"]), (i, ext, found[i]["extension"], found[i]["confidence"], body[:40])


def test_declared_bias_changes_type_and_reason(spark):
    rows = blob.column(spark.createDataFrame([("1", b"some plain words here\n")], "id string, content binary"), "id", "content", F.lit("md"))
    x = detect.detect(rows).first()
    assert (x["extension"], x["mime_type"]) == ("md", "text/markdown") and x["reason"].endswith("bias:decl:md")


def test_patterns_for_java_match_as_those_of_the_sql(spark):
    import re

    from bytelore.functions import textual
    from bytelore.functions.dialect import DUCK, SPARK

    assert not re.search(r"\[[^\]]*(A-Z|a-z|0-9)", textual.number_sql(SPARK)) and "A-Z" in textual.number_sql(DUCK)
    texts = ["Get-Item", "x Get-Item", "xGet-Item", "-Get-Item", "Get-item", "Get-I", "Get-It", "9New-Ab", "a--Set-Ab", "Reset-Ab Out-Xy", "\nWhere-Object", "", None, " $a = 1", "x\n$b=", "x$b=", "$", "-----BEGIN CERTIFICATE-----", "x\n-----BEGIN CERTIFICATE-----", "x-----BEGIN CERTIFICATE-----"]
    asked = {"verb": next(v["verb_noun"] for v in textual.cues(SPARK) if "verb_noun" in v), "weak": next(v["ps_weak"] for v in textual.cues(SPARK) if "ps_weak" in v), "pem": next(r.when for r in textual.rules(SPARK) if r.reason == "text:pem-cert")}
    df = spark.createDataFrame([(t,) for t in texts], "h string").selectExpr("h", "lower(h) as hl").selectExpr("h", *(f"{v} as {k}" for k, v in asked.items()))
    verbs = "Get|Set|New|Remove|Add|Invoke|Start|Stop|Import|Export|Write|Test|Enable|Disable|Update|Select|Where|Out|Clear|Copy|Move|Join|Split"
    for r in df.collect():
        if r.h is None:
            assert r.verb is None and r.pem is None
            continue
        assert r.verb == bool(re.search(rf"(^|[^A-Za-z-])({verbs})-[A-Z][A-Za-z]+", r.h)) and r.pem == bool(re.search(r"(^|\n)-----BEGIN CERTIFICATE-----", r.h)), r
        assert (r.weak > 0) == bool(re.search(r"(^|\n)\s*\$[A-Za-z_][A-Za-z0-9_]*\s*=", r.h) or re.search("get-|set-", r.h.lower())), r
