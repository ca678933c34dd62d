"""Candidates, declared types, assessment rules, and the whole record of a content."""

import base64

import pytest
from pyspark.sql import functions as F

from bytelore.functions import image, zipdir
from bytelore.operators import analyze, assess, candidates, declared, views
from bytelore.plans import made
from bytelore.sources import blob


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()["x"]


# candidates


def ranked(spark, text, said="", settings=None):
    df = spark.createDataFrame([(text, said)], "text string, said string")
    return candidates.with_candidates(df, "text", "said", settings).first()["candidates"]


def test_every_rule_that_holds_gives_a_candidate(spark):
    text = "# Title\n\n```\nparam([string]$x)\nGet-ChildItem | Where-Object { $_ }\n```\n"
    found = {c.ext: c for c in ranked(spark, text)}
    assert {"md", "ps1", "txt"} <= set(found) and found["ps1"].is_dangerous and not found["md"].is_dangerous
    assert found["txt"].score < 50 and [c.score for c in ranked(spark, text)] == sorted((c.score for c in found.values()), reverse=True)
    said = {c.ext: c.score for c in ranked(spark, text, "md")}
    assert said["md"] == min(79, found["md"].score + 3) and said["ps1"] < found["ps1"].score
    assert ranked(spark, None) == [] and ranked(spark, "") == [] and ranked(spark, " \n") == []


def test_settings_move_scores(spark):
    text = "just some words in a row"
    plain = {c.ext: c.score for c in ranked(spark, text)}
    moved = {c.ext: c.score for c in ranked(spark, text, settings={"txt": 2, "ext:txt": 3, "text:plain": 1, "reason:text:plain": 1, "csv": 9})}
    assert moved["txt"] == plain["txt"] + 7 and {c.ext: c.score for c in ranked(spark, text, settings={"txt": 900})}["txt"] == 59
    table = spark.createDataFrame([("txt", 2), ("txt", 1), (None, 5), ("md", None)], "key string, points long")
    assert {c.ext: c.score for c in ranked(spark, text, settings=table)}["txt"] == plain["txt"] + 3
    with pytest.raises(ValueError, match="settings"):
        candidates.settings_of(spark.range(candidates.MOST_SETTINGS + 1).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("points")))


def test_primary_type(spark):
    c = "array<struct<ext:string,confidence:string,reason:string,score:int>>"
    rows = [
        ("txt", "text:plain", [("ps1", "High", "a", 90), ("txt", "Low", "b", 50)], "", "ps1"), ("csv", "x", [("md", "Low", "a", 55), ("csv", "Low", "b", 50)], "", "csv"), ("csv", "x", [("md", "Low", "a", 56), ("csv", "Low", "b", 50)], "", "md"),
        ("txt", "text:plain", [("csv", "Low", "a", 53), ("log", "Low", "b", 52), ("txt", "Low", "b", 50)], "log", "log"), ("csv", "x", [("csv", "Low", "a", 53), ("log", "Low", "b", 52)], "log", "csv"), ("png", "magic", [("txt", "Low", "a", 59)], "", "png"),
        (None, None, [("log", "Low", "a", 50)], "log", "log"), (None, None, [], "log", None), ("eml", "text:eml", [("log", "High", "a", 99), ("eml", "Low", "b", 50)], "", "eml"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, ext string, reason string, c {c}, said string, want string")
    got = df.select("i", "want", candidates.choose_primary(F.col("ext"), F.col("reason"), F.col("c"), F.col("said")).alias("p")).orderBy("i").collect()
    assert [r.p.ext for r in got] == [r.want for r in got] and got[0].p.reason == "a;primary:score" and got[3].p.reason == "b;primary:declared"


# declared types


@pytest.mark.parametrize(
    ("said", "found", "fits"),
    [
        ("txt", "ps1", False), ("ps1", "txt", True), ("cmd", "log", True), ("log", "bat", False), ("CER", ".crt", True), ("yml", "yaml", True), ("admx", "xml", True), ("xml", "adml", True), ("admx", "adml", False), ("inf", "toml", True),
        ("config", "json", True), ("json", "cfg", True), ("conf", "csv", False), ("csv", "log", True), ("dll", "exe", True), ("exe", "dll", False), ("sys", "exe", True), ("scr", "exe", True), ("msi", "ole2", True), ("psd1", "psm1", True), ("doc", "ole2", False), ("png", "jpg", False),
    ],
)
def test_what_stands_for_what(spark, said, found, fits):
    assert one(spark, declared.compare(F.lit(said), F.lit(found)))["mismatch"] is not fits


def test_reasons_of_a_comparison(spark):
    ask = lambda *a: one(spark, declared.compare(*(F.lit(x).cast("string") for x in a)))
    assert ask("txt", None)["reason"] == "no-detection-or-declared" == ask(None, "txt")["reason"] and ask("docx", "zip", "docx")["mismatch"] is False and ask("jar", "zip", "docx")["reason"] == "decl:jar vs det:zip"
    assert ask("jar", None, "docx")["reason"] == "decl:docx vs det:docx(guess)".replace("decl:docx", "decl:jar")


def test_comparison_in_detail(spark):
    c = "array<struct<ext:string,confidence:string,score:int>>"
    rows = [
        (0, "txt", "txt", [("ps1", "High", 90), ("txt", "Low", 50)]), (1, "ps1", "txt", [("ps1", "High", 90)]), (2, "md", "ps1", [("md", "Medium", 80), ("ps1", "High", 90)]), (3, "txt", "png", [("bat", "Medium", 79)]), (4, "", "txt", [("ps1", "High", 90)]),
        (5, "png", "jpg", []), (6, None, None, []),
    ]
    df = spark.createDataFrame(rows, f"i int, said string, found string, c {c}")
    got = [r.x for r in df.select("i", declared.compare_in_detail(F.col("said"), F.col("found"), F.col("c")).alias("x")).orderBy("i").collect()]
    assert got[0].mismatch and got[0].reason == "match;declared-bypass:strong-dangerous-alt;alt-danger:ps1" and got[0].found_dangerous and not got[0].declared_dangerous
    assert not got[1].mismatch and got[1].declared_matches_alternative and got[1].declared_dangerous
    assert not got[2].mismatch and got[2].reason == "decl:md vs det:ps1;alt-match:declared" and got[3].mismatch and got[3].strong_alternatives == []
    assert not got[4].mismatch and got[4].reason == "no-detection-or-declared" and got[5].mismatch and not got[6].mismatch


# assessment


def codes(spark, factors):
    return {f["code"]: f["weight"] for f in one(spark, factors)}


def names(*values):
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def test_what_counts_once(spark):
    risky = names("contains_executables", "contains_scripts", "contains_installers", "disguised_executables")
    assert one(spark, assess.score(assess.flag_factors(names("contains_executables", "disguised_executables", "contains_installers")))) == 50
    assert codes(spark, assess.flag_factors(risky)) == {"Archive.ContainsScripts": 20, "Archive.ContainsInstallers": 25, "Archive.DisguisedExecutables": 25}
    assert codes(spark, assess.flag_factors(names("contains_executables", "contains_scripts"), F.lit("MSIX"))) == {}
    assert codes(spark, assess.flag_factors(names("contains_executables", "contains_scripts"), F.lit("jar"))) == {"Archive.ContainsExecutables": 25, "Archive.ContainsScripts": 20}
    assert codes(spark, assess.finding_factors(names("tool:x", "tool:y"), names("contains_scripts"))) == {} and codes(spark, assess.finding_factors(names("tool:x", "tool:y"), names())) == {"Tool.Indicator": 10}
    assert codes(spark, assess.finding_factors(names("sig:mkatz", "sig:X1001", "sig:X1005"))) == {"Sig.MimikatzEncodedHint": 30, "Sig.ProcdumpHint": 20}


def test_encoded_and_embedded(spark):
    ask = lambda kind, inner, *found: codes(spark, assess.encoded_factors(F.lit(kind).cast("string"), F.lit(inner).cast("string"), names(*found)))
    assert ask("b64", "EXE") == {"Encoded.Present": 10, "Encoded.InnerExecutable": 20} and ask("hex", "ps1") == {"Encoded.Present": 10, "Encoded.InnerScript": 15} and ask(None, "exe") == {} == ask("", None)
    assert ask(None, None, "html:data-uri=2", "html:data-exts=png:3, ps1:1") == {"Encoded.Embedded": 10, "Encoded.EmbeddedScript": 15} and ask(None, None, "script:data-exts=exe:1,js:2") == {"Encoded.EmbeddedExecutable": 20, "Encoded.EmbeddedScript": 15}


def test_signatures(spark):
    s = "struct<present:boolean,self_signed:boolean,chain_valid:boolean,envelope_valid:boolean,trusted:boolean,timestamped:boolean>"
    rows = [
        ((True, True, False, True, False, False), ["Sig.SelfSigned"]), ((True, False, False, False, False, False), ["Sig.ChainInvalid", "Sig.BadEnvelope"]), ((True, None, True, None, False, False), ["Sig.WinTrustInvalid"]), ((True, None, None, None, True, False), ["Sig.NoTimestamp"]),
        ((True, None, True, True, True, True), []), ((False, None, None, None, None, None), ["Sig.Absent"]), (None, ["Sig.Absent"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, s {s}, want array<string>")
    got = df.select("want", F.transform(assess.signature_factors(F.lit("exe"), F.lit(None).cast("string"), F.col("s")), lambda f: f["code"]).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    assert codes(spark, assess.signature_factors(F.lit("txt"), F.lit("appx"))) == {"Sig.Absent": 10} and codes(spark, assess.signature_factors(F.lit("txt"), F.lit(None).cast("string"))) == {}


def test_types_names_and_packages(spark):
    c = F.array(*(F.struct(F.lit(e).alias("ext"), F.lit(d).alias("is_dangerous")) for e, d in (("txt", False), ("ps1", True))))
    kinds = lambda ext, confidence, reason="r", cs=c, off=False, **more: codes(spark, assess.type_factors(F.lit(ext), F.lit(confidence), F.lit(reason), cs, F.lit(off), **more))
    assert kinds("txt", "Low") == {"Type.LowConfidenceRisk": 10, "Type.AmbiguousCandidates": 8, "Type.DangerousAlternative": 12}
    assert kinds("exe", "High", "extension:exe", F.slice(c, 1, 1), True) == {"Type.ExtensionOnlyRisk": 12, "Type.DangerousMismatch": 30} and kinds("txt", "High", cs=F.slice(c, 1, 1)) == {}
    assert kinds("zip", "High", cs=F.slice(c, 1, 1), guessed=F.lit("exe"), validation=F.lit("skipped")) == {"Type.GuessedSubtypeRisk": 8, "Type.ValidationUncertain": 4}
    assert codes(spark, assess.name_factors(names("double_extension", "bidi", "mismatch"))) == {"Name.DoubleExtension": 15, "Name.BiDiOverride": 25, "Name.ExtensionMismatch": 10}
    made_by = lambda who, signer=None, **more: codes(spark, assess.package_factors(F.lit(who).cast("string"), F.lit(True), F.lit(signer).cast("string"), names("pe:regsvr"), allowed=["acme"], **more))
    assert made_by("ACME Inc") == {"Package.VendorPresent": 0, "Package.VendorAllowed": -15, "PE.RegSvrExport": 10} and made_by(None, "Acme") == {"Package.VendorUnknown": 0, "Sig.VendorAllowed": -10, "PE.RegSvrExport": 10}
    assert made_by("x", capabilities=names("rescap:runFullTrust"), extensions=names("windows.protocol"))["Appx.Capability.RunFullTrust"] == 20


# executables


def test_images():
    exports = [f"Entry{i}" for i in range(5000)]
    data = made.image(exports, {"CompanyName": "Acme, Inc", "FileVersion": "1.2.3", "Other": "x"}, b"x" * 9000)
    found = image.parse(zipdir.reader(data), len(data))
    assert found.exports == exports[: image.MOST_EXPORTS] and found.version == {"CompanyName": "Acme, Inc", "FileVersion": "1.2.3"} and [s[0] for s in found.sections] == [".text", ".rsrc"]
    assert image.parse(zipdir.reader(b"MZ"), 2) is None and image.parse(zipdir.reader(b"MZ" + bytes(100)), 102) is None and image.parse(zipdir.reader(data[:300]), 300).exports == []
    import random

    for seed in range(200):
        r = random.Random(seed)
        noisy = bytearray(made.image(exports[:20], {"CompanyName": "x"}))
        for _ in range(5):
            noisy[r.randrange(60, len(noisy))] = r.randrange(256)
        image.parse(zipdir.reader(bytes(noisy)), len(noisy))


# the whole record


def test_the_whole_record(spark, monkeypatch):
    program = made.executable(2, 2, b"x" * 300)
    rows = [
        ("exe", "invoice.pdf.exe", made.image(["DllRegisterServer"], {"CompanyName": "Acme"})), ("b64", "a.txt", base64.b64encode(program * 2)), ("ps1", "notes.txt", b"param([string]$x)\nGet-ChildItem | Where-Object { $_ }\niex (New-Object Net.WebClient)\n"),
        ("js", "a.js", b"const p = 'data:text/x-powe' + 'rshell,Start-Sleep%201'; function f() { return module.exports; }"), ("zip", "a.zip", made.zipped({"run.exe": program, "a.ps1": b"x"})), ("key", "id", b"-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\n"),
        ("none", None, None), ("empty", "e", b""), ("doc", "m.doc", made.compound({"WordDocument": b"x"}, ("Macros", "VBA"))), ("html", "p.html", b"<!DOCTYPE html><html><script src='data:text/javascript,x'></script></html>"), ("html", "twice", b"<html> https://A.example/x </html>"),
    ]
    df = spark.createDataFrame([(i, n, c) for i, n, c in rows], "id string, name string, content binary")
    files = blob.column(df, "id", "content").drop("name").join(df.select("id", "name").dropDuplicates(["id"]), "id").withColumn("declared_ext", blob.extension_of(F.col("name")))
    record = analyze.analyze(files, allowed_vendors=["acme"])
    got = {r.id: r for r in record.where("name is null or name <> 'twice'").collect()}
    assert record.count() == len(rows)
    assert got["exe"].detection.extension == "dll" and got["exe"].executable.version == {"CompanyName": "Acme"} and {"pe:exports=1", "pe:regsvr"} <= set(got["exe"].findings) and "double_extension" in got["exe"].name_issues
    assert {"Package.VendorAllowed", "PE.RegSvrExport", "Name.DoubleExtension"} <= set(got["exe"].assessment.codes)
    assert got["b64"].encoded.kind == "b64" and got["b64"].encoded.inner_extension == "exe" and {"enc:b64", "enc:det:exe"} <= set(got["b64"].findings) and {"Encoded.Present", "Encoded.InnerExecutable"} <= set(got["b64"].assessment.codes)
    assert got["ps1"].detection.extension == "ps1" and got["ps1"].declared.mismatch and "ps:iex" in got["ps1"].findings and "Type.DangerousMismatch" in got["ps1"].assessment.codes
    assert "script:data-exts=ps1:1" in got["js"].findings and "Encoded.EmbeddedScript" in got["js"].assessment.codes
    assert got["zip"].container.entry_count == 2 and set(got["zip"].flags) == {"contains_executables", "contains_scripts"} and got["zip"].assessment.score == 45 and got["zip"].assessment.decision == "Warn"
    assert got["key"].secrets.private_keys == 1 and "secret:privkey" in got["key"].findings and "ole_macros" in got["doc"].flags and "office:vba" in got["doc"].findings and "html:data-uri=1" in got["html"].findings
    for r in (got["none"], got["empty"]):
        assert r.detection.extension is None and r.findings == [] and r.assessment.score == 0 and r.error is None
    report = {r.id: r.m for r in record.select("id", analyze.summary_map(F.create_map(F.lit("kind"), F.lit("mine"), F.lit("more"), F.lit("x"))).alias("m")).where("id in ('zip', 'none')").collect()}
    assert report["zip"]["extension"] == "zip" and report["zip"]["kind"] == "Archive" and report["zip"]["more"] == "x" and report["none"]["score"] == "0" and "extension" not in report["none"]
    assert analyze.analyze(files.where("id = 'nothing'")).collect() == []
    views_of = {w: {r.id: r for r in views.view(record, w).where("name is null or name <> 'twice'").collect()} for w in ("summary", "detection", "analysis", "assessment", "certificate", "executable")}
    assert views_of["summary"]["zip"].flags == "contains_executables,contains_scripts" and views_of["assessment"]["zip"].decision == "Warn" and views_of["executable"]["exe"].company == "Acme"
    assert views_of["analysis"]["zip"].container_entry_count == 2 and ".txt Low" in views_of["detection"]["ps1"].alternatives and views_of["certificate"]["zip"].bundle_count is None
    with pytest.raises(ValueError, match="views are"):
        views.view(record, "none")


def test_a_row_that_fails_is_told(monkeypatch):
    monkeypatch.setattr(analyze.archives, "zip_entries", lambda c: 1 / 0)
    found = analyze._facts(b"PK\3\4")
    assert found["error"].startswith("ZeroDivisionError") and found["entries"] is None and analyze._facts(None)["error"] is None


def test_first_key_wins(spark):
    m = lambda d: F.create_map(*(F.lit(x) for p in d.items() for x in p)) if d else F.lit(None).cast("map<string,string>")
    assert one(spark, analyze.first_key_wins(m({"a": "1"}), m(None), m({"a": "2", "b": "3"}), m({"b": "4", "c": "5"}))) == {"a": "1", "b": "3", "c": "5"}


# logs


LOGS = {
    "text:log-firewall": "#Version: 1.5\n#Software: Microsoft Windows Firewall\n#Fields: date time action\n", "text:log-netlogon": "[MISC] NetrLogonSamLogon called\nNETLOGON secure channel reset\n", "text:event-txt": "Log Name: System\nSource: x\nEvent ID: 7\nbody\n",
    "text:log-dhcp": "#Software: Microsoft DHCP Server\n#Version: 1.0\n#Fields: id\n", "text:log-exchange": "#Software: Microsoft Exchange\n#Log-type: Message Tracking Log\n#Fields: date-time\n", "text:log-nps": "#Software: Microsoft Network Policy Server\n#Version: 1\n#Fields: a\n",
    "text:log-defender": "MpCmdRun output of Windows Defender\nAntivirus engine version 1 found a threat\n", "text:log-sql-errorlog": "SQL Server is starting\nServer process ID is 5 spid7\n", "text:log-sqlagent": "SQLSERVERAGENT starting service\nwith a job\n",
    "text:log-dns": "DNS Server log file creation\nLog file created at 1/2/2024\n", "text:log-powershell-transcript": "**********************\nWindows PowerShell transcript start\nStart time: 2024\n",
}


def test_families_of_logs(spark):
    from bytelore.operators import detect

    got = detect.classify_text(spark.createDataFrame(list(LOGS.items()), "want string, text string")).collect()
    assert {r.want: (r.extension, r.reason) for r in got} == {k: ("log", k) for k in LOGS}
    paths = "c:\\a\\b.txt: Access is denied\n\\\\srv\\x: cannot find it\nD:/q: The system cannot open\nother\n"
    for said, want in (("'log'", "text:log-path-errors"), ("''", None)):
        reason = detect.classify_text(spark.createDataFrame([(paths,)], "text string"), "text", said).first().reason
        assert reason == want or (want is None and reason != "text:log-path-errors")
    near = ["Defender service started", "sql server is nice", "netlogon once", "the windows firewall", "dns server log"]
    assert {r.extension for r in detect.classify_text(spark.createDataFrame([(x,) for x in near], "text string")).collect()} == {"txt"}


def test_log_class(spark):
    from bytelore.functions import logs

    stamped = "\n".join(f"2024-01-0{i % 9 + 1} x" for i in range(12))
    rows = [(stamped, True), ("\n".join(stamped.split("\n")[:9]), False), ("INFO a\nWARN b\nERROR c\nERR d\ninfo e", True), ("INFO a\nWARN b", False), ("Log Name: x Event ID: 5", True), ("a\nb", False), ("", False), (None, False)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, want boolean").select("i", "want", logs.log_class(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c.is_log for r in got] == [r.want for r in got] and (got[2].c.info, got[2].c.warn, got[2].c.error) == (2, 1, 2)


# names and measures


def test_names(spark):
    from bytelore.functions import metrics

    rows = {
        "a.pdf.exe": ["double_extension"], "Foo.Bar_1.2.3_x64.msi": [], "Foo_1.2.3_x64.msi": [], "setup.2024.exe": [], "a.docx.2.exe": ["double_extension"], "app.exe.1234.dmp": [], "app.exe.1234.protected.dmp": [], "app.txt.1234.dmp": ["double_extension"],
        ".bashrc": ["hidden"], "..": [], " a.txt": ["blanks"], "a  b.txt": ["blanks"], "a.txt ": ["blanks"], "ab‮gpj.exe": ["bidi"], "plain.txt": [], "": [], "noext": [], "tar.gz.": [], ".a.b": ["hidden"],
    }
    df = spark.createDataFrame([(n, w) for n, w in rows.items()] + [(None, [])], "n string, want array<string>")
    wrong = [(r.n, r.got, r.want) for r in df.select("n", "want", metrics.name_issues(F.col("n")).alias("got")).collect() if r.got != r.want]
    assert wrong == []
    assert one(spark, metrics.name_issues(F.lit("a.txt"), F.lit(True))) == ["mismatch"] and one(spark, metrics.name_issues(F.lit("noext"), F.lit(True))) == []


def test_measures(spark):
    from bytelore.functions import metrics

    pdf = b"%PDF-1.7 /JS /OpenAction /Filespec /EF /Filespec /Filespec /Filespec startxref startxref startxref"
    assert set(one(spark, metrics.pdf_flags(F.lit(pdf)))) == {"pdf_javascript", "pdf_open_action", "pdf_embedded_files", "pdf_many_embedded_files", "pdf_many_updates"} and one(spark, metrics.pdf_flags(F.lit(b"%PDF"))) == []
    lines = lambda b, n, s=1_000_000: one(spark, metrics.line_estimate(F.lit(b).cast("binary"), F.lit(n), s))
    assert (lines(b"a\nb\n", 4), lines(b"a\nb\n" * 10, 40, 20), lines(b"", 0), lines(None, 0), lines(b"\xff\n\x80\n", 4)) == (2, 20, 0, None, 2)
    small = lambda t: one(spark, metrics.is_minified(F.lit(t)))
    assert small("x=1;" * 400) and not small("x=1;" * 100) and not small("x = 1;\n" * 400) and not small("x  " * 600) and small(None) is False
    assert one(spark, metrics.has_service_marker(F.lit(b"..ServiceMain.."))) and not one(spark, metrics.has_service_marker(F.lit(bytes(300_000) + b"ServiceMain")))


def test_trace_logs(spark):
    import struct

    from bytelore.operators import detect

    buffer = lambda size, version, zeros, provider: struct.pack("<II", size, version) + bytes(zeros) + b"x" * (40 - zeros) + struct.pack("<I", provider) + bytes(200)
    rows = [(b"ElfF" + b"x" * 100, "etl"), (b"ElfFile\0" + bytes(100), "evtx"), (buffer(65536, 0x102, 30, 7), "etl"), (buffer(65537, 0x102, 30, 7), None), (buffer(1 << 21, 0x102, 30, 7), None), (buffer(4096, 0x500, 30, 7), None), (buffer(4096, 0x200, 20, 7), None), (buffer(4096, 0x200, 40, 0), None)]
    files = blob.column(spark.createDataFrame([(str(i), b) for i, (b, _) in enumerate(rows)], "id string, content binary"), "id", "content")
    got = {r.id: r.extension for r in detect.detect(files).collect()}
    assert [got[str(i)] == "etl" for i in range(len(rows))] == [w == "etl" for _, w in rows] and got["1"] == "evtx"


def test_candidates_display(spark):
    c = F.array(*(F.struct(F.lit(e).alias("ext"), F.lit("Low").alias("confidence"), F.lit(n).alias("score")) for n, e in enumerate(["md", "txt", "", "csv", "ini", "log", "js"])))
    assert one(spark, views.candidates_display(c, F.lit("txt"))) == ".md Low 0; *.txt Low 1; .csv Low 3; .ini Low 4; .log Low 5" and one(spark, views.candidates_display(F.slice(c, 3, 1), F.lit("x"))) is None


def test_short_texts_are_not_empty(spark, tmp_path):
    from bytelore.plans.records import analyzed_documents

    texts = [None, "", "A.", "Re.", " \n", "\x01\x02", "some words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.empty for r in analyzed_documents(spark, str(tmp_path)).collect()}
    assert got == {i: not t for i, t in enumerate(texts)}


def test_tables_that_are_folders(spark, tmp_path):
    from bytelore.plans.records import table_files

    spark.range(4, numPartitions=1).coalesce(1).write.parquet(f"{tmp_path}/a")
    next((tmp_path / "a").glob("*.parquet")).rename(tmp_path / "one.parquet")
    spark.range(40).repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    kind = ("parquet", "application/vnd.apache.parquet", "High", True, True)
    assert sorted(map(tuple, table_files(spark, str(tmp_path)).collect())) == [("many.parquet", *kind), ("one.parquet", *kind)]
    (tmp_path / "many.parquet" / "odd.parquet").write_bytes(b"no table")
    assert sorted((r.name, r.extension) for r in table_files(spark, f"{tmp_path}/").collect()) == [("many.parquet", "parquet"), ("many.parquet", "txt"), ("one.parquet", "parquet")]


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 65536).alias("text"))
    files = blob.column(made.contents(docs, lambda key, text: text * 2), "doc_id", "content")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"])

    got = files.select("content").mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in got) == 400 and max(r.bytes for r in got) <= blob.BATCH_BYTES + (1 << 18)


def test_flags_are_worked_out_once(spark):
    from bytelore.plans.queries import flag_scores

    plan = flag_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("THEN disguised_executables") <= 1
