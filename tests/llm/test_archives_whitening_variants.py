"""Archives, whitening and spelling variants against brute force, round trips and odd input."""

import gzip
import hashlib
import io
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from bytelore.llm import queries, variants, warc, whiten

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def sha1(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()


# archives


def made(n: int = 6) -> tuple[list[tuple[bytes, bytes]], bytes]:
    parts = []
    for i in range(n):
        payload = random.Random(i).randbytes(7 ** (i + 1))
        parts.append(warc.record(f"urn:page:{i}", "response", "http://x.example/\r\nbad: 1", "2020-01-01T00:00:00Z", hashlib.sha1(payload).hexdigest(), payload))
    return parts, b"".join(h + b + b"\r\n\r\n" for h, b in parts)


@pytest.mark.parametrize("form", ["one stream", "plain", "members", "junk before", "padding", "no blank lines"])
def test_records_of_archives(form):
    parts, raw = made()
    data = {
        "one stream": gzip.compress(raw), "plain": raw, "members": b"".join(gzip.compress(h + b + b"\r\n\r\n") for h, b in parts),
        "junk before": gzip.compress(b"x" * (3 << 20) + b"\n" + raw), "padding": gzip.compress(raw) + b"\0" * 5000, "no blank lines": gzip.compress(b"".join(h + b for h, b in parts)),
    }[form]
    assert [(h, b"".join(block)) for h, _, block in warc.records_of(io.BytesIO(data).read)] == parts


@pytest.mark.parametrize("data", [b"", gzip.compress(b""), b"WARC/", b"WARC/1.0\r\n", b"\x1f\x8bnot gzip", b"WARC/1.0\r\nContent-Length: x\r\n\r\nabc", b"\n" * 10])
def test_archives_without_records(data):
    assert list(warc.records_of(io.BytesIO(data).read)) == []


def test_archive_that_breaks_off():
    parts, raw = made()
    got = [(h, b"".join(block)) for h, _, block in warc.records_of(io.BytesIO(gzip.compress(raw)[:-40_000]).read)]
    assert got[:5] == parts[:5] and got[5][0] == parts[5][0] and parts[5][1].startswith(got[5][1]) and len(got[5][1]) < len(parts[5][1])
    # what follows damage is found again
    damaged = raw.replace(b"Content-Length: " + str(len(parts[1][1])).encode(), b"Content-Length: ?", 1)
    assert [h for h, _, _ in warc.records_of(io.BytesIO(damaged).read)] == [h for i, (h, _) in enumerate(parts) if i != 1]


def test_a_long_record_is_rewritten_piece_by_piece():
    payload = bytes(40 << 20)
    head, block = warc.record("urn:page:1", "response", None, "d", hashlib.sha1(payload).hexdigest(), payload)
    data = gzip.compress(head + block + b"\r\n\r\n", 1)
    largest = 0
    for _, _, pieces in warc.records_of(io.BytesIO(data).read):
        largest = max(map(len, pieces))
    assert 0 < largest <= warc.PIECE


def test_normalised_archives_read_alone(spark, tmp_path):
    parts, raw = made()
    for name, data in (("a", gzip.compress(raw)), ("b", raw), ("c", b""), ("d", gzip.compress(raw)[:-40_000])):
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file:{tmp_path}/{x}.warc.gz",) for x in "abcd"], "file string")
    (tmp_path / "out").mkdir()
    index = warc.normalise(files, f"file:{tmp_path}/out").cache()
    rows = index.collect()
    assert len(rows) == 18 and sum(not r.whole for r in rows) == 1 and {r.record_type for r in rows} == {"response"}
    for r in rows:
        with open(r.file, "rb") as f:
            f.seek(r.offset)
            member = f.read(r.length)
        text = gzip.decompress(member)
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and f"<{r.record_id}>".encode() in text
    for out in (tmp_path / "out").glob("*.warc.gz"):
        whole = gzip.decompress(out.read_bytes())
        assert whole == raw or raw.startswith(whole[:-4])
        lines = (tmp_path / "out" / f"{out.name}.cdxj").read_text().splitlines()
        assert len(lines) == 6
    read = warc.read_records(index.where("whole")).collect()
    assert len(read) == 17 and all(r.intact for r in read)
    assert {(r.record_id, r.payload_bytes) for r in read} == {(f"urn:page:{i}", 7 ** (i + 1)) for i in range(6)}


def by_hand(rows):
    groups: dict[str, list] = {}
    for k, _, t in rows:
        if len((t or "").encode()) >= 1000:
            groups.setdefault(t, []).append(k)
    out = []
    for k, _, t in rows:
        last = max((x for x in groups.get(t, []) if x is not None), default=None)
        again = last is not None and k != last
        out.append((k, len((t or "").encode()), sha1(t or ""), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_pages_that_are_odd(spark, tmp_path):
    long = "é😀" * 200_000
    same = "a" * 1000
    rows = [
        (1, None, same), (2, "http://x\r\nWARC-Type: no", same), (2, "u", same), (3, "u", "a" * 999), (4, "u", "a" * 999), (5, "u", None), (6, None, ""), (None, "u", same), (None, None, None), (7, "u", long), (8, "u", long),
        (-9, "u", "b" * 2000), (-8, "u", "b" * 2000), (9, "u", "WARC/1.0\r\nContent-Length: 5\r\n\r\n" * 50), (None, "u", "c" * 1000), (None, "u", "c" * 1000), *((100 + i, "u", "d" * 1500) for i in range(300)),
    ]
    pages = spark.createDataFrame([(*r, 1, "x", b"y", "z") for r in rows], PAGES + ", salt int, digest string, payload binary, body string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op11_monolithic_archives(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op11_monolithic_archives(spark, str(tmp_path)).collect() == []


# whitening


def whole_numbers(vectors):
    return np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)


def check_whitening(rows, vectors, k):
    x = whole_numbers(vectors)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(s) for s in ((n * x - sums) ** 2).sum(axis=1)]
    centred = (x - 1_000_000).astype(float) - ((sums - n * 1_000_000) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > 1e-12 * values.sum()).sum()))
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * k
    for c in range(1, k + 1):
        mine = np.array([got[(i, c)].whitened for i in range(n)])
        sign = np.sign(mine @ want[:, c - 1])
        assert np.allclose(mine * sign, want[:, c - 1], atol=1e-7) and abs(got[(0, c)].explained / (values[c - 1] / values.sum()) - 1) < 1e-9
    assert [got[(i, 1)].deviation for i in range(n)] == deviation and {r.n for r in rows} == {n}
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-10


@pytest.mark.parametrize(("n", "d", "k", "block"), [(300, 8, 32, None), (500, 40, 5, None), (400, 60, 4, 5), (50, 64, 32, None), (3, 10, 32, None)])
def test_whitening(spark, n, d, k, block):
    r = np.random.default_rng(n + d)
    vectors = (r.standard_normal((n, d)) * (1 + np.arange(d)[::-1] / 7)).astype(np.float32).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(5)
    model = whiten.fit(df, k=k, block=block)
    assert model.residual < 1e-12
    check_whitening(whiten.whitened(df, model).collect(), vectors, k)


def test_whitening_needs_many_small_blocks(spark):
    vectors = np.random.default_rng(7).standard_normal((600, 120)).astype(np.float32).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    model = whiten.fit(df, k=3, block=4)
    assert model.passes > 13 and model.residual < 1e-12  # blocks were left and started anew
    check_whitening(whiten.whitened(df, model).collect(), vectors, 3)


def test_vectors_that_are_odd(spark, tmp_path):
    good = [[float(i % 7), float(i % 3) - 1e6, 2.5] for i in range(20)]
    bad = [None, [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 1.0], [1.0, float("-inf"), 0.0], [1.0], [], [1.0] * 5]
    rows = [*((i, v) for i, v in enumerate(good)), *((100 + i, v) for i, v in enumerate(bad)), (None, good[0]), (3, good[3])]
    df = spark.createDataFrame([(*r, 1, "x", 0.5, 2) for r in rows], "vec_id long, embedding array<float>, n int, key string, v double, component int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_subspace_whitening(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted([(False, i, c) for i in [*range(20), 3] for c in (1, 2)] + [(True, 0, c) for c in (1, 2)])
    x = whole_numbers([*good, good[0], good[3]])
    assert {r.deviation for r in got if r.vec_id == 5} == {int(((22 * x[5] - x.sum(axis=0)) ** 2).sum())}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None], [[]]])
def test_nothing_to_whiten(spark, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    assert whiten.whitened(df, whiten.fit(df)).collect() == []


def test_deviation_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [3e17, 0.0]), (1, [-3e17, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten.whitened(df, whiten.fit(df)).collect()} == {None}


# spelling variants


def neighbours(word: str, alphabet: str) -> set[str]:
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in alphabet:
        out |= {word[:i] + c + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1)}
    return out - {word}


@pytest.mark.parametrize("at_once", [3, 50, 1 << 21])
@pytest.mark.parametrize("word", ["a", "aab", "abcde", "aaaa", "xxabbé", "zyxÿ÷"])
def test_neighbourhood(monkeypatch, word, at_once):
    monkeypatch.setattr(variants, "AT_ONCE", at_once)
    alphabet, seen = "abcxéÿ", []
    raw = lambda s: np.frombuffer(s.encode("latin-1"), np.uint8)

    def keep(h):
        seen.extend(h.tolist())
        return np.arange(len(h))

    got = [s.decode("latin-1") for _, s in variants.neighbourhood(raw(word).reshape(1, -1), raw(alphabet), keep)]
    assert len(got) == len(set(got)) and set(got) == neighbours(word, alphabet)
    assert [int(variants._prefixes(raw(g).reshape(1, -1))[0][0, -1]) for g in got if g] == [h for g, h in zip(got, seen) if g]


def variants_by_hand(rows, mutate=31, least=7):
    count: dict[str, int] = {}
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if mutate and h % mutate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] = count.get(run, 0) + 1
    count = {w: n for w, n in count.items() if n >= 2}
    alphabet = "".join(sorted(set("".join(count))))
    near = {w: sorted((x for x in neighbours(w, alphabet) if x in count), key=lambda x: (-count[x], x)) for w in count}
    form = {w: near[w][0] for w in count if near[w] and count[near[w][0]] >= 10 * count[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w), count[form[w]] if w in form else None, root(w)) for w, n in count.items())


def many_spellings():
    r = random.Random(5)
    chain = ["colourful"] * 8000 + ["colorful"] * 600 + ["colorfull"] * 40 + ["colorfuull"] * 2 + ["colurful"] * 21 + ["Colourfül"] * 5 + ["tie" * 3] * 2 + ["tietiet"] * 30 + ["tietietix"] * 30
    words = chain + ["".join(r.choices("abÀé", k=r.randrange(6, 9))) for _ in range(3000)] + ["z" * 5000, "z" * 5001] * 12 + ["short"] * 50
    r.shuffle(words)
    rows = [(i % 40, " ".join(words[i::90]) + "; 😀1") for i in range(90)]
    return [*rows, (None, "nowhere nowhere nowheer nowheer"), (None, None), (1, None), (2, ""), (3, "12 34"), rows[0]]


def test_variants(spark, tmp_path):
    rows = many_spellings()
    clash = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], "doc_id long, text string, n int, word string, root string, key int")
    clash.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_spelling_variants(spark, str(tmp_path))
    want = variants_by_hand(rows)
    assert sorted(map(tuple, got.collect())) == want
    by_word = {w[0]: w for w in want}
    assert by_word["colorfuull"][5] == "colourful" and by_word["colorfuull"][3] == "colorfull"


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(variants, "LEAST_BITS", 15)
    monkeypatch.setattr(variants, "MOST_BITS", 15)
    r = random.Random(9)
    words = ["".join(r.choices("ab", k=7)) for _ in range(400)] + ["".join(r.choices("abcdefghij", k=8)) for _ in range(9000)]
    rows = [(1, " ".join(words * 2))]
    got = variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == variants_by_hand(rows, None)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(1, "seldom words onceonly")]])
def test_no_words(spark, rows):
    assert variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), mutate=31).collect() == []


# the queries and their SQL


@pytest.mark.parametrize("name", ["op11_monolithic_archives", "op13_spelling_variants"])
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, want.select(*order).fetchall()))


def test_whitening_of_the_table(spark):
    rows = queries.op12_subspace_whitening(spark, SF).collect()
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    check_whitening(rows, vectors, 32)
