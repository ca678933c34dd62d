import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bytelore.llm import linedup, neardup


def groups(links, nodes):
    root = {n: n for n in nodes}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, size):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    keys = [k for k in sets if sets[k]]
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {k: (len(s), groups(links, sets)[k]) for k, s in sets.items()} if len(sets) < 50 else {k: (len(sets[k]), g) for k, g in groups(links, sets).items()}


def altered(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("join", [neardup.Join(), neardup.Join(small=3), neardup.Join(small=2, depth=1), neardup.Join(small=5, depth=20)])
def test_near_duplicates_match_brute_force(spark, prose, join):
    r = random.Random(7)
    texts = [None, "", " \n", "a", "A", "a b", "one two three", *(prose(i, r.randint(5, 150)) for i in range(40))]
    for i in range(30):
        texts += [altered(texts[7 + i], r.choice([0, 1, 1, 2, 4, 6]), r) for _ in range(r.choice([1, 1, 3]))]
    hub, common = prose(900, 120), prose(901, 80)
    texts += [altered(hub, r.randint(1, 6), r) for _ in range(40)] + [f"{prose(1000 + i, 25)} {common}" for i in range(40)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x[0]: (x[1], x[2], x[3]) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, join=join).collect()}
    for k, (n, g) in brute(rows, 4).items():
        assert got[k] == (n, g, g == k), rows[k]


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 105), (105, 103)] + [(200, 200 + i) for i in range(1, 40)] + [(1, 1)]
    random.Random(1).shuffle(edges)
    got = dict(neardup.components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert got == {k: v for k, v in groups(edges, {x for e in edges for x in e}).items()}


def test_components_of_few_edges_take_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = neardup.components(spark.createDataFrame([(0, i) for i in range(1, 400)], "x long, y long"))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert dict(found.collect()) == dict.fromkeys(range(400), 0)
    assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism  # each task wrote a file


@pytest.mark.parametrize("most", [neardup.MOST_BITS, 15])
def test_sets_of_ids_shuffle_no_texts(spark, prose, monkeypatch, most):
    monkeypatch.setattr(neardup, "LEAST_BITS", 15)
    monkeypatch.setattr(neardup, "MOST_BITS", most)
    plans, store = [], neardup.store
    monkeypatch.setattr(neardup, "store", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df, name))
    docs = spark.createDataFrame([(i, prose(i, 9)) for i in [*range(6000), 5999]] + [(5999, prose(1, 20)), (-7, "a b c"), (7001, None)], "_id long, _text string")
    ids = spark.createDataFrame([(i,) for i in [*range(0, 6000, 7), 5999, -7]], "_id long").distinct()
    got = {x["_id"]: len(x["items"]) for x in neardup._sets_of(ids, docs, 4, "some").collect()}
    assert got == {**{i: 6 for i in range(0, 6000, 7)}, 5999: 17, -7: 1}
    assert plans[-1].index("Join LeftSemi") < plans[-1].index("MapInArrow")  # texts became sets before the join


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = neardup.near_duplicates(odd).collect()
    assert Counter(x[0] for x in rows) == Counter(x["doc_id"] for x in odd.collect())
    by = {x["doc_id"]: x for x in rows}
    assert by[5]["component_id"] == 4 and by[7]["component_id"] == 6 and not by[7]["kept"] and by[1]["kept"] and by[None]["component_id"] is None
    assert [x["kept"] for x in rows if x["doc_id"] == 8] == [True, True]
    empty = neardup.near_duplicates(odd.where("doc_id = -1"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def brute_lines(rows):
    seen, gone = [], set()
    for k, t in sorted((k, t) for k, t in rows if t is not None):
        for i, line in enumerate(t.split("\n")):
            w = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            if w:
                if any(100 * len(w & v) >= 80 * len(w | v) for v in seen):
                    gone.add((k, i))
                seen.append(w)
    return gone


def test_lines_match_brute_force(spark, prose):
    r = random.Random(3)
    pool = [prose(i, r.randint(1, 25)) for i in range(60)]
    line = lambda: altered(x, r.choice([0, 0, 1, 2]), r) if (x := r.choice(pool)) else x
    rows = [(i, None if i == 3 else "\n".join(r.choice(["", " ", line(), line().upper()]) for _ in range(r.randrange(9)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x["doc_id"], x["line_no"]) for x in linedup.later_matches(docs).collect()} == brute_lines(rows)
    gone = brute_lines(rows)
    out = dict(linedup.dedup_lines(docs, drop_emptied=False).collect())
    for k, t in rows:
        assert out[k] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone))


def test_pipeline_drops_short_lines_too(spark, prose):
    import corpus_pipeline

    r = random.Random(4)
    pool = ["all rights reserved here", "All rights reserved here today", "la la la la la la la la la", "版权所有，未经许可不得转载。", "ok", "one two", "two one", *(prose(i, r.randint(1, 7)) for i in range(20))]
    rows = [(i, "\n".join([prose(100 + i, 9), *(r.choice(["", " \t", r.choice(pool)]) for _ in range(6))])) for i in range(60)]
    want, seen = {}, []
    for k, t in rows:
        kept = []
        for line in t.split("\n"):
            w = frozenset(line.lower().split())
            if not w or not any(100 * len(w & v) >= 80 * len(w | v) for v in seen):
                kept.append(line)
            seen += [w] if w else []
        want[k] = "\n".join(kept)
    assert dict(corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()) == want


def test_lines_use_no_python(spark, odd, prose):
    plan = linedup.dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_first_lines_of_words_need_no_window(spark, prose, monkeypatch):
    plans, store = [], linedup.store
    monkeypatch.setattr(linedup, "store", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df, name))
    linedup.later_matches(spark.createDataFrame([(i, prose(i % 2, 12)) for i in range(4)], "doc_id long, text string")).collect()
    assert plans and not any("Window" in p for p in plans)


def test_prefixes_of_lines_are_shuffled_once(spark, prose, monkeypatch):
    plans, store = {}, linedup.store
    monkeypatch.setattr(linedup, "store", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or store(df, name))
    linedup.later_matches(spark.createDataFrame([(i, prose(i % 2, 12)) for i in range(4)], "doc_id long, text string")).collect()
    initial = plans["maybe"]
    sides = re.findall(r"Generate posexplode\(prefix#\d+\), \[([^\]]*)\]", initial)
    assert len(sides) == 2 and re.sub(r"#\d+L?", "", sides[0]) == re.sub(r"#\d+L?", "", sides[1])


@pytest.mark.parametrize("most", [linedup.MOST_BITS, 8])
def test_words_of_candidate_lines_shuffle_no_texts(spark, prose, monkeypatch, most):
    monkeypatch.setattr(linedup, "LEAST_BITS", 8)
    monkeypatch.setattr(linedup, "MOST_BITS", most)
    plans, store = {}, linedup.store
    monkeypatch.setattr(linedup, "store", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or store(df, name))
    r = random.Random(8)
    rows = [(i, "\n".join([prose(i, 20), altered(prose(r.randrange(60), r.choice([3, 9, 20, 400])), r.randrange(4), r)])) for i in range(200)]
    got = linedup.later_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["line_no"]) for x in got} == brute_lines(rows)
    assert plans["words"].index("Join LeftSemi") < plans["words"].index("Generate posexplode(split(")  # lines, not texts, meet the candidates


def test_sketches_bound_differences_without_steps_for_words(spark, prose, monkeypatch):
    r = random.Random(6)
    sets = [r.sample([x for i in range(200) for x in (i * 2**56 - 2**63, r.randrange(-(2**63), 2**63))], r.randrange(0, 200)) for _ in range(60)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id int, hashes array<long>")
    for words in (linedup.NARROW, linedup.WIDE):
        among = F.sort_array(F.concat("hashes", F.array(*linedup._bounds(words)))).alias("among")
        bits = {x[0]: x[1] for x in rows.select("id", among).select("id", linedup._sketches(words)).collect()}
        apart = lambda a, b: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(a, b, strict=True))
        assert all(apart(bits[i], bits[j]) <= len(set(sets[i]) ^ set(sets[j])) for i in bits for j in bits)
        assert apart(bits[0], bits[1]) > 0 and len(bits[0]) == words
    plans, store = {}, linedup.store
    monkeypatch.setattr(linedup, "store", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or store(df, name))
    linedup.later_matches(spark.createDataFrame([(i, prose(i % 2, 12)) for i in range(4)], "doc_id long, text string"))
    assert "aggregate(" not in plans["lines"] and "aggregate(" not in plans["words"]


def test_lines_of_odd_rows(spark, odd):
    out = linedup.dedup_lines(odd)
    rows = out.collect()
    ids = Counter(x["doc_id"] for x in rows)
    assert out.columns == odd.columns and ids[5] == 0 and ids[4] == 1 and ids[1] == ids[2] == ids[3] == 1 and ids[8] == 2 and ids[None] == 2
    assert [x["text"] for x in rows if x["doc_id"] == 7] == [] or len([x["text"] for x in rows if x["doc_id"] == 7][0]) < 10
    assert linedup.dedup_lines(odd.where("doc_id = -1")).count() == 0


def test_lines_of_rows_that_repeat_a_key(spark, prose):
    rows = [(1, "x\n" + prose(1, 9)), (2, "\n".join([prose(2, 9), prose(1, 9)])), (2, "\n".join([prose(3, 9), prose(4, 9)])), (2, "\n".join([prose(3, 9), prose(4, 9)]))]
    out = sorted(linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == sorted([rows[0], (2, prose(2, 9)), rows[2], rows[3]])


def test_unlike_lines_of_a_repeated_key_stay(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (2, "q r s t u v w x y z"), (3, "q r s t u v w x y zz")]
    out = linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == [rows[0], rows[2]]


def test_near_lines_under_repeated_keys(spark, prose):
    r = random.Random(11)
    pool = [prose(i, r.randint(1, 14)) for i in range(25)]
    line = lambda: altered(x, r.choice([0, 0, 1, 1, 2]), r) if (x := r.choice(pool)) else x
    rows = [(i % 12, "\n".join(r.choice(["", line(), line()]) for _ in range(r.randrange(1, 6)))) for i in range(60)]
    sets = [(k, i, t, frozenset(x.lower().split())) for k, t in rows for i, x in enumerate(t.split("\n"))]
    similar = lambda w, v: 100 * len(w & v) >= 80 * len(w | v)
    want = {(k, t, i) for k, i, t, w in sets if w and any(v and (j, m) < (k, i) and similar(w, v) for j, m, _, v in sets)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).distinct()
    got = {(x["doc_id"], x["text"], x["line_no"]) for x in linedup.later_matches(docs).join(texts, "text_hash").collect()}
    assert got == want


def test_pipeline_matches_brute_force(spark, prose, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(11)
    item = prose(500, 14)
    body = lambda i: "\n".join(prose(1000 * i + k, r.randint(8, 30)) for k in range(5))
    texts = {i: body(i) for i in range(60)}
    for i in range(0, 60, 4):
        texts[i] = f"nasty rude words {texts[i]} rude nasty"
    texts[61] = texts[1]
    texts[62] = altered(texts[2].replace("\n", " "), 1, r)
    texts[63] = f"{prose(900, 30)} {item} {prose(901, 30)}"
    texts[64], texts[65], texts[66] = item, None, ""
    spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        seen.append({x["doc_id"]: x["text"] for x in docs.collect()})
    clean, lines, single, safe = seen
    assert set(clean) == {k for k in texts if k >= 60 or k % 4} and all(clean[k] == texts[k] for k in clean)
    gone = brute_lines(clean.items())
    want = {k: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in clean.items()}
    assert lines == {k: t for k, t in want.items() if t is None or t.strip() or not clean[k].strip()} and 61 not in lines
    assert set(single) == {k for k, (_, g) in brute(lines.items(), 5).items() if g == k} and 62 not in single
    assert 64 not in safe and item not in safe[63] and {k: t for k, t in single.items() if k not in (63, 64)} == {k: t for k, t in safe.items() if k != 63}
    tokenizer, ids = Tokenizer.from_file(public.path("word_bpe_49k.json")), {}
    for x in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda x: (x["doc_id"], x["start"])):
        ids.setdefault(x["doc_id"], []).extend(x["ids"])
    assert ids == {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in safe.items()}


def test_recall_in_a_node_of_thousands(spark, prose):
    """5,000 documents that differ from one in 1 to 18 of 120 words, with default parameters: who hangs together does so."""
    import numpy as np

    r = random.Random(5)
    hub = prose(77, 120)
    rows = [(i, altered(hub, r.randint(1, 18), r)) for i in range(5000)]
    shingles = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    base = sorted({tuple(hub.split()[i : i + 4]) for i in range(117)})
    has = np.array([[b in s for b in base] for s in shingles], np.float32)  # all other shingles are of one document
    common, n = (has @ has.T).astype(int), np.array([len(s) for s in shingles])
    linked = 100 * common >= 80 * (n[:, None] + n - common)
    got = {x[0]: x[2] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    root = np.array([got[i] for i in range(5000)])
    met = linked & (root[:, None] == root)
    assert met.sum() >= 0.999 * linked.sum()
    assert all(linked[i].sum() > 1 for i in range(5000) if (root == root[i]).sum() > 1)


def test_pipeline_keeps_the_same_row_of_a_key(spark, prose):
    import corpus_pipeline

    rows = [(1, prose(1, 30), "b"), (1, prose(2, 40), "a"), (1, prose(2, 40), "c"), (2, prose(2, 40) + " x", None), (3, None, "d"), (3, "", "e"), (None, prose(1, 30), "f"), (4, prose(5, 20), "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    out = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[2], rows[5], rows[6], rows[7]], key=str)
    assert corpus_pipeline.keep_one_of_each(spark, docs.where("doc_id = -1"), "").count() == 0
