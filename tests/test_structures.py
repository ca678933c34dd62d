"""Directories of ZIP and OLE files, DER values, encoded payloads, nested contents and the source that reads ranges."""

import base64
import binascii
import gzip
import json
import os
import quopri
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from bytelore.functions import compound, der, payloads, zipdir
from bytelore.operators import detect, nested
from bytelore.plans import made
from bytelore.sources import blob, ranged


class Counted:
    """Reads ranges of bytes and counts them."""

    def __init__(self, data: bytes) -> None:
        self.data, self.bytes = data, 0

    def __call__(self, offset: int, n: int) -> bytes:
        out = self.data[max(0, offset) : max(0, offset) + max(0, n)]
        self.bytes += len(out)
        return out


# ZIP


def names_of(data):
    found = zipdir.entries(zipdir.reader(data), len(data))
    return None if found is None else [e.name for e in found]


def test_zip_directory():
    body = {"a/é.txt": b"hello " * 5000, "b.bin": os.urandom(70_000), "empty": b"", "d/": b""}
    for stored in (True, False):
        data = made.zipped(body, stored)
        read = zipdir.reader(data)
        found = zipdir.entries(read, len(data))
        assert {e.name: zipdir.body(read, e, 1 << 20) for e in found} == body and [e.size for e in found] == [len(b) for b in body.values()]
        assert zipdir.body(read, found[0], 7) == b"hello h"
    inner = made.zipped({"lib.jar": made.zipped({"META-INF/MANIFEST.MF": b"x"})})
    assert names_of(inner) == ["lib.jar"] and names_of(b"junk" * 99 + inner) == ["lib.jar"]
    assert names_of(inner + b"PK\5\6" * 3) == ["lib.jar"] or names_of(inner + b"PK\5\6" * 3) is None
    assert names_of(b"") is None and names_of(b"PK\3\4 no end") is None and names_of(made.zipped({})) == []


def test_zip_comments_links_and_wide_fields(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        link = zipfile.ZipInfo("link")
        link.external_attr = (0o120777) << 16
        z.writestr(link, "../x")
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"w" * 1000)
        z.comment = b"a comment with PK\5\6 in it"
    data = (tmp_path / "a.zip").read_bytes()
    read = zipdir.reader(data)
    found = {e.name: e for e in zipdir.entries(read, len(data))}
    assert found["link"].symlink and not found["wide"].symlink and zipdir.body(read, found["wide"], 5000) == b"w" * 1000
    marked = bytearray(data)
    at = data.rfind(b"PK\1\2")
    marked[at + 8] |= 1
    assert [e.encrypted for e in zipdir.entries(zipdir.reader(bytes(marked)), len(marked))] == [False, True]


def test_zip_reads_little():
    data = made.zipped({"big": os.urandom(5 << 20), "mimetype": b"application/epub+zip"})
    counted = Counted(data)
    assert len(zipdir.entries(counted, len(data))) == 2 and counted.bytes < 70_000


# OLE


@pytest.mark.parametrize("shift", [9, 12])
def test_ole_directory_in_scattered_sectors(shift):
    streams = {f"Stream {i}": bytes([i]) * (i * 37) for i in range(60)} | {"long": b"x" * 100_000}
    data = made.compound(streams, ("VBA",), shift)
    found = compound.entries(zipdir.reader(data), len(data))
    assert [e.name for e in found] == ["Root Entry", *streams, "VBA"] and [e.kind for e in found] == ["root", *["stream"] * 61, "storage"]
    assert [e.size for e in found[1:-1]] == [len(b) for b in streams.values()]
    counted = Counted(data)
    compound.entries(counted, len(data))
    assert counted.bytes < len(data) / 2


def test_ole_table_longer_than_its_header():
    """The table has more sectors than a header names: those of its last part are named by another sector."""
    sector, n_fat = 512, 110
    last = n_fat * 128 - 1  # the directory lies where only the last table sector links it
    header = bytearray(struct.pack("<8s16sHHHHH6sIIIIIIIIII", compound.MAGIC, b"", 0x3E, 3, 0xFFFE, 9, 6, b"", 0, n_fat, last - 1, 0, 4096, 0xFFFFFFFE, 0, n_fat, 1, 0).ljust(512, b"\0"))
    header[76:512] = struct.pack("<109I", *range(109))
    sparse = {-1: bytes(header), n_fat: struct.pack("<128I", 109, *[0xFFFFFFFF] * 126, 0xFFFFFFFE), 109: struct.pack("<128I", *[0] * 126, last, 0xFFFFFFFE)}
    entry = lambda name: struct.pack("<64sHB53sQ", name.encode("utf-16-le"), 2 * len(name) + 2, 2, b"", 7)
    sparse |= {last - 1: entry("first").ljust(512, b"\0"), last: entry("WordDocument").ljust(512, b"\0")}

    def read(offset, n):
        number, within = divmod(offset, sector)
        return sparse.get(number - 1, bytes(512))[within : within + n]

    assert [e.name for e in compound.entries(read, (last + 2) * sector)] == ["first", "WordDocument"]


def test_ole_that_is_broken():
    good = made.compound({"WordDocument": b"x" * 3000}, ("S",) * 20)
    read = lambda d: compound.entries(zipdir.reader(d), len(d))
    directory = struct.unpack_from("<I", good, 48)[0]
    fat = struct.unpack_from("<I", good, 76)[0]
    circle = bytearray(good)
    struct.pack_into("<I", circle, (fat + 1) * 512 + 4 * directory, directory)
    assert len(read(bytes(circle))) == 4
    away = bytearray(good)
    struct.pack_into("<I", away, (fat + 1) * 512 + 4 * directory, 5_000_000)
    assert len(read(bytes(away))) == 4
    for broken in (good[:100], good[:512], good[:30] + b"\xff\xff" + good[32:], b"", good[:48] + b"\xf0\xff\xff\x0f" + good[52:]):
        assert read(broken) is None
    for seed in range(200):
        r = random.Random(seed)
        noisy = bytearray(good)
        for _ in range(20):
            noisy[r.randrange(24, len(noisy))] = r.randrange(256)
        read(bytes(noisy))


# DER

ROOT, ME = {"2.5.4.6": "PL", "2.5.4.10": "Root, Inc", "2.5.4.3": "root"}, {"2.5.4.3": "mé", "1.2.3.4": "x"}


def test_certificates():
    one = made.certificate(ME, ROOT, "990101000000Z", "99991231235959Z", "a.example")
    f = der.facts(one)
    assert f["kind"] == "cer" and f["subject"] == "OID.1.2.3.4=x, CN=mé" and f["issuer"] == 'CN=root, O="Root, Inc", C=PL'
    assert (f["not_before"].year, f["not_after"].year, f["key_algorithm"], f["self_signed"], f["san_present"]) == (1999, 9999, "RSA", False, True)
    assert der.facts(one + b"more")["thumbprint"] == f["thumbprint"] and der.facts(made.certificate(ME, ME, "500101000000Z", "490101000000+0130"))["self_signed"]
    assert der.facts(made.signed_data(one, made.certificate(ROOT, ROOT, "240101000000Z", "250101000000Z")))["bundle"] == [f["subject"], f["issuer"]]
    assert der.facts(made.key_store(b"x"))["kind"] == "p12"


def test_indefinite_lengths():
    one = made.certificate(ME, ROOT, "990101000000Z", "250101000000Z")
    inner = made.tlv(0x30, made.tlv(2, b"\1"), made.tlv(0x31), made.tlv(0x30, made.oid(der.PKCS7_DATA)), b"\xa0\x80" + one + b"\0\0", made.tlv(0x31))
    data = b"\x30\x80" + made.oid(der.PKCS7_SIGNED) + b"\xa0\x80" + inner + b"\0\0" + b"\0\0"
    assert der.facts(data)["bundle"] == ["OID.1.2.3.4=x, CN=mé"] and der.facts(data[:-1]) is None and der.facts(b"\x30\x80\x02\x80\0\0\0\0") is None


def test_values_that_are_no_certificates():
    one = made.certificate(ME, ROOT, "990101000000Z", "250101000000Z")
    body, alg, sig = (one[e.start : e.end] for e in der.parse(one).kids)
    other = made.tlv(0x30, made.oid("1.2.3"), made.tlv(5))
    bad = [
        one[:-1], b"", b"\x30", b"\x30\x00", b"0 plain text that begins with a zero", made.tlv(0x30, body, alg, sig, made.tlv(2, b"\1")), made.tlv(0x30, body, other, sig), made.tlv(0x30, body, alg, made.tlv(3, b"\0")),
        made.tlv(0x30, made.tlv(2, b"\2"), made.tlv(0x30, made.oid(der.PKCS7_DATA), made.tlv(0xA0, b""))), made.tlv(0x30, made.tlv(2, b"\3"), made.tlv(0x30, made.oid("1.2.3"), made.tlv(0xA0, b""))),
        made.tlv(0x30, made.oid(der.PKCS7_SIGNED), made.tlv(0xA0, b""), made.tlv(5)), b"\x30\x80" * 100_000, b"\x30\x84\xff\xff\xff\xff" + one, b"\x3f\x81\x01\x00",
    ]
    assert [der.facts(b) for b in bad] == [None] * len(bad)
    for seed in range(300):
        r = random.Random(seed)
        noisy = bytearray(one)
        noisy[r.randrange(len(noisy))] = r.randrange(256)
        der.facts(bytes(noisy))


def test_certificate_columns(spark):
    one = made.certificate(ME, ROOT, "990101000000Z", "99991231235959Z")
    pem = "x\n-----BEGIN CERTIFICATE-----\r\n" + base64.encodebytes(one).decode() + "-----END CERTIFICATE-----"
    df = spark.createDataFrame([(0, one, None), (1, None, None), (2, b"0 text", None), (3, None, pem), (4, None, "-----BEGIN CERTIFICATE-----%%-----END CERTIFICATE-----")], "i int, b binary, t string")
    got = df.select("i", der.der_facts(F.coalesce("b", der.pem_body(F.col("t")))).alias("c")).select("i", "c.*", der.name_part(F.col("c.issuer"), "cn").alias("cn"), der.name_part(F.col("c.issuer"), "XX").alias("xx")).orderBy("i").collect()
    assert [r.kind for r in got] == ["cer", None, None, "cer", None] and got[0].not_before.isoformat() == "1999-01-01T00:00:00" and (got[3].cn, got[3].xx) == ("root", None)


# payloads


def test_payloads(spark):
    rows = []
    for i in range(30):
        body = random.Random(i).randbytes(150 + 7 * i) + (b"\0" * 8 if i % 3 else b"")
        uu = "begin 644 x\n" + "".join(binascii.b2a_uu(body[j : j + 45]).decode() for j in range(0, len(body), 45)) + "`\nend\n"
        rows += [
            ("b64", base64.b64encode(body).decode(), body), ("b64", base64.urlsafe_b64encode(body).decode(), body), ("b64", "text %% " + base64.encodebytes(body).decode(), body),
            ("b64", "-----BEGIN X-----\n" + base64.encodebytes(body).decode() + "-----END X-----", body), ("hex", body.hex(), body), ("hex", "(" + body.hex(" ", 2) + ")", body),
            ("b85", "x" + base64.a85encode(body, adobe=True, wrapcol=60).decode(), body), ("uu", uu, body), ("uu", "some\n" + uu.replace("\n", "\r\n"), body), ("qp", quopri.encodestring(body, quotetabs=True).decode(), body),
        ]
    rows += [("b64", "short", None), ("hex", "abcd", None), ("b85", "no", None), ("b85", "<~~>", None), ("b85", "<~uuuuu~>", None), ("uu", "begin", None), ("qp", "", None), ("other", "x" * 500, None), ("b64", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, t string, want binary")
    for r in df.select("i", "k", "t", "want", payloads.payload(F.col("t"), F.col("k")).alias("got")).collect():
        want = bytes(r.want) if r.want is not None else None
        if r.k == "qp" and want is not None:
            want = want.replace(b"\r", b"").replace(b"\n", b"")  # line ends go, as they may be the encoder's
            assert bytes(r.got).replace(b"\r", b"").replace(b"\n", b"") == want
        else:
            assert (bytes(r.got) if r.got is not None else None) == want, (r.i, r.k, r.t)


def test_encoded_texts_are_told(spark):
    long = bytes(range(256)) * 3
    prose = "Some words. And more words! Then again others. "
    rows = [
        (base64.encodebytes(long).decode(), "b64"), (base64.b64encode(long * 3).decode(), "b64"), (long.hex(), "hex"), (long.hex(" "), "hex"), (quopri.encodestring(("é" * 40).encode()).decode(), "qp"),
        ("Content-Transfer-Encoding: quoted-printable\n\na=3Db=3Dc and so on", "qp"), (prose * 5, "txt"), ("a=3D" + prose, "txt"), ("<b>" + base64.b64encode(long).decode() + "</b>", "txt"),
        ("2024-01-02 10:00:00 INFO " + base64.b64encode(long).decode() + "\n2024-01-02 10:00:01 INFO x", "log"),
    ]
    got = detect.classify_text(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, want string")).collect()
    assert [(r.i, r.extension) for r in got] == [(r.i, r.want) for r in got]


# nested contents


def unwrapped(spark, contents, **limits):
    files = blob.column(spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "id string, content binary"), "id", "content")
    return nested.unwrap(files, nested.Limits(**limits))


def test_nested(spark):
    program = made.executable(2, 2, b"x" * 300)
    word = made.zipped({"[Content_Types].xml": b"", "word/document.xml": b'<?xml version="1.0"?><a/>'})
    contents = [
        base64.b64encode(gzip.compress(program, 0)), made.zipped({"in.zip": made.zipped({"run.exe": program}), "d/": b""}, stored=False), gzip.compress(made.tarred({"a/w.docx": word})), None, b"", b"PK\3\4broken",
        made.zipped({"enc.txt": base64.b64encode(program)}), b"just some words in a row",
    ]
    opened = unwrapped(spark, contents)
    rows = {(r.id, r.path): r for r in opened.collect()}
    assert len(rows) == opened.count()
    assert rows[("1", "!in.zip!run.exe")].extension == "exe" and rows[("1", "!in.zip!run.exe")].depth == 2 and rows[("2", "!content!a/w.docx")].extension == "docx"
    assert rows[("2", "!content!a/w.docx!word/document.xml")].via == "docx" and rows[("6", "!enc.txt!b64")].extension == "exe" and bytes(rows[("6", "!enc.txt!b64")].content) == program
    assert {r.id: r.findings for r in nested.nested_findings(opened).collect()} == {
        "0": ["enc:b64", "enc:det:exe"], "1": ["nested:exe", "nested:zip"], "2": ["nested:docx", "nested:tar", "nested:xml"], "6": ["enc:b64", "enc:det:exe", "nested:b64"],
    }
    assert unwrapped(spark, []).collect() == []


def test_budgets(spark):
    bomb = made.zipped({f"{i}.zip": made.zipped({f"{j}.txt": b"a" * 100_000 for j in range(20)}, stored=False) for i in range(20)}, stored=False)
    rows = unwrapped(spark, [bomb], total_bytes=500_000).where("depth > 0").collect()
    assert sum(len(r.content or b"") for r in rows) <= 500_000 and any(not r.whole for r in rows)
    few = unwrapped(spark, [bomb], entries=3, entry_bytes=1000).where("depth > 0").collect()
    assert len(few) == 3 and {len(r.content) for r in few} <= {1000, *(r.length for r in few)}
    deep = b"x" * 100
    for i in range(12):
        deep = made.zipped({f"{i}.zip": deep})
    assert max(r.depth for r in unwrapped(spark, [deep], depth=4).collect()) == 4


# files in ranges


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "files"
    (root / "sub" / "deep").mkdir(parents=True)
    with open(root / "huge.bin", "wb") as f:  # sparse
        f.write(b"\x89PNG\r\n\x1a\n")
        f.truncate(3 << 30)
    with open(root / "image.img", "wb") as f:
        f.seek(0x8001)
        f.write(b"CD001")
        f.truncate(1 << 30)
    with open(root / "disk", "wb") as f:
        f.truncate(64 << 20)
        f.seek((64 << 20) - 512)
        f.write(b"koly" + bytes(508))
    (root / "sub" / "w.bin").write_bytes(made.zipped({"[Content_Types].xml": b"", "word/document.xml": os.urandom(3 << 20)}))
    (root / "sub" / "deep" / "m.dat").write_bytes(made.compound({"WordDocument": b"x" * (2 << 20)}))
    (root / "sub" / "c.der").write_bytes(made.certificate(ME, ROOT, "990101000000Z", "250101000000Z"))
    (root / "sub" / "t.ps1").write_text("just some words in a row")
    (root / "empty").write_bytes(b"")
    (root / "gone").symlink_to(root / "nowhere")
    return root


def test_types_of_files_in_ranges(spark, folder):
    rows = {r.name: r for r in detect.detect(ranged.files(spark, str(folder))).collect()}
    assert {n: r.extension for n, r in rows.items()} == {
        "huge.bin": "png", "image.img": "iso", "disk": "dmg", "w.bin": "docx", "m.dat": "doc", "c.der": "cer", "t.ps1": "ps1", "empty": None,
    }
    assert rows["huge.bin"].length == 3 << 30 and all(r.error is None for r in rows.values())
    read = sum(len(r.head or b"") + len(r["tail"] or b"") + len(r.volume or b"") for r in rows.values())
    assert read < 1 << 20


def test_a_directory_of_a_huge_file_is_read_alone(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("META-INF/MANIFEST.MF", "x")
    data = (tmp_path / "a.zip").read_bytes()
    end = data.rfind(b"PK\1\2")
    with open(tmp_path / "far.zip", "wb") as f:  # the directory behind 3 GB of nothing
        f.write(data[:end])
        f.seek(3 << 30)
        f.write(data[end:])
    before = int(open("/proc/self/io").read().split("rchar: ")[1].split("\n")[0])
    source = ranged._Source(spark.createDataFrame([], "path string, inside struct<names:array<string>,mimetype:string,der:string>").schema, {"path": str(tmp_path)})
    found = {f["name"]: source.row(ranged._system(str(tmp_path))[0], f) for f in source.walk(str(tmp_path), None)}
    assert found["far.zip"]["inside"]["names"] == ["META-INF/MANIFEST.MF"]
    assert int(open("/proc/self/io").read().split("rchar: ")[1].split("\n")[0]) - before < 1 << 20


def test_what_cannot_be_read(spark, folder):
    source = ranged._Source(ranged.files(spark, str(folder)).schema, {"path": str(folder)})
    listed = [f for f in source.walk(str(folder), None) if f["name"] == "c.der"]
    (folder / "sub" / "c.der").unlink()
    row = source.row(ranged._system(str(folder))[0], listed[0])
    assert row["error"].startswith("FileNotFoundError") and row["head"] is None and row["length"] == listed[0]["length"]
    lost = ranged.files(spark, str(folder / "nowhere"), columns=["path", "length", "error"]).collect()
    assert [(r.length, r.error.split(":")[0]) for r in lost] == [(None, "FileNotFoundError")]


def test_columns_ranges_and_globs(spark, folder):
    meta = ranged.files(spark, str(folder), columns=["name", "length"])
    assert meta.columns == ["name", "length"] and meta.agg(F.sum("length")).first()[0] > 4 << 30
    some = ranged.files(spark, f"file:{folder}", columns=["name", "at"], ranges={"at": (0x8001, 5)}, glob="*.img").collect()
    assert [(r.name, bytes(r["at"])) for r in some] == [("image.img", b"CD001")]
    last = ranged.files(spark, str(folder / "disk"), columns=["name", "last"], ranges={"last": (-512, 4)}).collect()
    assert [(r.name, bytes(r["last"])) for r in last] == [("disk", b"koly")]
    assert ranged.files(spark, str(folder), columns=["name"], recursive="false").where("name = 'c.der'").count() == 0
    lazy = ranged.files(spark, str(folder), columns=["name"], planDepth="1")
    assert lazy.count() == meta.count() and lazy.rdd.getNumPartitions() > 1
    with pytest.raises(Exception, match="no range is given"):
        spark.read.format("ranged_files").schema("odd binary").option("path", str(folder)).load().collect()


def test_filters_reach_the_listing(spark, folder):
    spark.conf.set(ranged.PUSH_DOWN, "true")
    try:
        found = ranged.files(spark, str(folder), columns=["name", "length", "declared_ext", "head"]).where("length < 1000000 and declared_ext in ('der', 'ps1')")
        assert sorted(r.name for r in found.collect()) == ["c.der", "t.ps1"]
        by_name = ranged.files(spark, str(folder), columns=["name", "head"]).where("name = 't.ps1'")
        assert by_name.count() == 1 and by_name.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset(ranged.PUSH_DOWN)


def test_a_stream_of_files(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    for i in range(3):
        path = source / f"{i}.bin"
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + bytes([i]))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
        rows = ranged.files(spark, str(source), columns=["name", "head"], stream=True)
        rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(str(out)).collect()
        assert sorted(r.name for r in got) == [f"{j}.bin" for j in range(i + 1)]
    json.dumps([r.name for r in got])


# JSON lines


def test_json_lines(spark):
    good, cut, noise = '{"a": {"b": [1, {"c": "}{"}]}, "d": ":"}', '{"a": {"b": 1}', "{a: b}"
    rows = [(f"{good}\n{good}", "ndjson"), (f"  {good} \r\n\t{good}\r\n{good}", "ndjson"), (f"{good}\n{cut}", "json"), (f"{cut}\n{good}", "json"), (f"{good}\n{noise}", "json"), ('{"a:b"}\n{"a:b"}', None), ("{:\"\"}\n{:\"\"}", None)]
    got = detect.classify_text(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, want string")).orderBy("i").collect()
    assert [r.extension if r.want else r.extension != "ndjson" for r in got] == [r.want or True for r in got]
    assert [r.confidence for r in got[:2]] == ["Low", "Medium"]


# strings of scripts

START, REST = "data:text/x-powe", "rshell,Start-Sleep%201"
FOLDED = [
    f"const p = '{START}{REST}';", f"const p = '{START}' + \"{REST}\";", f'const p = "data:text/" + ("x-powe" + "{REST}");', f'const p = "data:text/".concat("x-powe", "{REST}");', f"const p = `data:text/${{'x-powe' + '{REST}'}}`;",
    f"const p = `data:text/${{'x-powe'.concat('{REST}')}}`;", f'const p = "data:text/" + ["x-powe", "{REST}"].join("");', f'const p = `data:text/${{["x-powe", "{REST}"].join("")}}`;', f'const p = "data:text/" + (["x-powe", "{REST}"].join(""));',
    f'const p = `data:text/${{(["x-powe", "{REST}"].join(""))}}`;', f'const p = "data:text/" + ["x-powe"].join("").concat("{REST}");', f'const p = `data:text/${{["x-powe"].join("").concat("{REST}")}}`;', f"f(('{START}'), x); g('{START}' + /* why */ '{REST}' + tail)",
]
UNFOLDED = [
    f'const p = "data:text/" + ["x-powe", "{REST}"].join("-");', f'const p = "data:text/" + ["x-powe", "{REST}"].join(String());', f'const p = "data:text/" + ["x-powe", "{REST}"].join();', f'const e = "Sample: {START}{REST}";',
    f"// \"{START}{REST}\"\n/* '{START}{REST}' */", "const p = 'data:' + name;", "'data:", "`data:${`", "(" * 5000 + "'datum:x,y'", "data:text/plain,x", "",
]


def test_strings_are_put_together(spark):
    from bytelore.functions import scripts

    df = spark.createDataFrame([(i, t) for i, t in enumerate([*FOLDED, *UNFOLDED, None])], "i int, t string")
    got = df.select("i", scripts.script_data_uris(F.col("t")).alias("u")).withColumn("f", scripts.data_findings(F.col("u"), "script")).orderBy("i").collect()
    for r in got[: len(FOLDED)]:
        assert r.u == [START + REST] and r.f == ["script:data-uri=1", "script:data-exts=ps1:1"], r
    assert [r.u for r in got[len(FOLDED) :]] == [[]] * len(UNFOLDED) + [None]
    page = f"""<img src="data:image/gif;base64,R0lGODlhAQAB"><a href=data:text/css,x>x</a> <style>b {{ background: url(\n "data:text/css,body%7B%7D"\n) }} /* url(data:text/plain,no) */ .e {{ content: "data:text/plain,no" }}</style>data:text/plain,no <!-- <img src="data:text/plain,no"> -->"""
    one = spark.createDataFrame([(page,)], "t string").select(scripts.html_data_uris(F.col("t")).alias("u")).select("u", scripts.data_findings(F.col("u"), "html").alias("f"), F.transform("u", scripts.data_payload).alias("p")).first()
    assert one.u == ["data:image/gif;base64,R0lGODlhAQAB", "data:text/css,x", "data:text/css,body%7B%7D"] and one.f == ["html:data-uri=3", "html:data-exts=css:2,gif:1"] and [bytes(p) for p in one.p] == [b"GIF89a\1\0\1", b"x", b"body{}"]


# RAR and 7z


rar4, rar5, seven = made.rar4, made.rar5, made.seven


def test_rar_and_7z():
    from bytelore.functions import packed

    files = {"a.exe": b"MZ" * 30, "d/b.txt": b"hello", "c.ps1": b"x" * 300}
    told = lambda data: packed.listing(zipdir.reader(data), len(data))
    for make in (rar4, rar5):
        assert told(make(files)).entries == [(n, len(d), False) for n, d in files.items()] and not told(make(files)).encrypted_headers
        assert [e[2] for e in told(make(files, encrypted=True)).entries] == [True] * 3
        assert told(make(files, hidden=True)).encrypted_headers and told(make(files, hidden=True)).entries == []
        assert [e[0] for e in told(make(files)[:-320]).entries][:2] == ["a.exe", "d/b.txt"]
    for is_packed in (False, True):
        assert told(seven(files, is_packed)).entries == [(n, 0, False) for n in files] and told(seven(files, is_packed, aes=True)).entries == [(n, 0, True) for n in files]
    assert told(b"PK") is None and told(b"7z\xbc\xaf\x27\x1c").entries == [] and told(b"Rar!\x1a\x07\x00").entries == [] and told(b"Rar!\x1a\x07\x01\x00" + b"\xff" * 50).entries == []
    for seed in range(300):
        r = random.Random(seed)
        noisy = bytearray(r.choice([rar4, rar5, seven])(files))
        for _ in range(3):
            noisy[r.randrange(8, len(noisy))] = r.randrange(256)
        told(bytes(noisy))


def test_facts_of_packed_archives(spark):
    from bytelore.operators import archives

    files = {"a.exe": b"MZ" * 30, "d/b.txt": b"hello", "../c.ps1": b"x" * 300}
    made_ = [rar5(files), seven(files, True), rar4(files, encrypted=True), rar5(files, hidden=True), b"no archive", None]
    rows = blob.column(spark.createDataFrame([(str(i), c) for i, c in enumerate(made_)], "id string, content binary"), "id", "content")
    got = archives.with_entries(rows).select("id", archives.archive_facts(F.col("entries")).alias("f"), "entries").orderBy("id").collect()
    assert all({"contains_executables", "contains_scripts", "archive_path_traversal"} <= set(r.f.flags) and r.f.entry_count == 3 for r in got[:3]) and got[2].f.encrypted_count == 3
    assert got[3].f.flags == ["archive_encrypted_entries"] and got[4].entries is None and got[5].entries is None


# Office links


def test_office_links(spark):
    from bytelore.operators import office

    rel = lambda *targets: "<Relationships>" + "".join(f'<Relationship Target="{t}"/>' for t in targets) + "</Relationships>"
    book = made.zipped(
        {
            "[Content_Types].xml": b"", "xl/workbook.xml": b"", "xl/externalLinks/externalLink1.xml": b"", "xl/_rels/workbook.xml.rels": rel("externalLinks/externalLink1.xml", "http://ok.example.com/a", "https://bad.example.org:80/x").encode(),
            "xl/externalLinks/_rels/externalLink1.xml.rels": rel("\\\\srv\\share\\b.xlsx", "file:///c:/x", "//cdn.example.org/y", "http://").encode(), "other/_rels/x.rels": rel("http://not.example.net").encode(),
        },
        stored=False,
    )
    word = made.zipped({"word/_rels/document.xml.rels": b'<R Type="x/attachedTemplate" Target="http://t.example" TargetMode="External"/>', "word/document.xml": b"<w> DDEAUTO c:\\\\x </w>"})
    rows = blob.column(spark.createDataFrame([("0", book), ("1", word), ("2", made.zipped({"a": b""})), ("3", None), ("4", b"PKno")], "id string, content binary"), "id", "content")
    got = [r.f for r in office.with_parts(rows).select("id", office.link_facts(F.col("entry_names"), F.col("parts"), ["*.example.com"]).alias("f")).orderBy("id").collect()]
    assert (got[0].external_links, got[0].allowed, got[0].disallowed, got[0].unc) == (2, 1, 2, 2) and got[0].hosts == ["ok.example.com", "bad.example.org", "cdn.example.org"] and got[0].flags == ["office_external_links"]
    assert got[0].findings == ["ooxml:ext-links=2", "ooxml:ext-allowed=1", "ooxml:ext-disallowed=2", "ooxml:unc=2", "ooxml:hosts=ok.example.com,bad.example.org,cdn.example.org"]
    assert got[1].flags == ["office_remote_template", "office_possible_dde"] and got[1].findings == [] and got[2].flags == []
