"""Plain versions beside the operators, hot keys, and odd rows of every operator."""

import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import common, extract, fingerprint, langid, mixing, queries, sharding, simhash, urlfilter, warc

from .test_operators import ODD, PAGE, WORDS, brute_similar, documents, language_rows, texts, water_fill


# ---- joins on hot keys


def test_join_hot_keeps_every_row(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}", "x") for i in range(3000)] + [(9999, None, "x"), (9998, "none", "x")]
    many = spark.createDataFrame(rows, "id long, k string, tasks string")
    one = many.where("k is not null and k <> 'none'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    inner = common.join_hot(many, one, "k", F.col("n"), 3002)
    assert sorted(r["id"] for r in inner.collect()) == list(range(3000)) and set(inner.columns) == {"id", "k", "tasks", "n"}
    assert common.join_hot(many, one, "k", F.col("n"), 3002, "left").count() == 3002


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(Session())


# ---- fingerprints


def plain_digest(text):
    """Bucket quartiles counted triplet by triplet."""
    raw = list((text or "").encode())
    counts = [0] * 128
    for i in range(len(raw)):
        a, b, c = (raw[j] if j < len(raw) else 0 for j in (i, i + 4, i + 8))
        key = ((a << 16 | b << 8 | c) * 2654435761) % 2**32
        key ^= key >> 15
        key = key * 2246822519 % 2**32
        key ^= key >> 13
        counts[key % 128] += 1
    q = sorted(counts)
    codes = [sum(n > q[i] for i in (31, 63, 95)) for n in counts]
    digits = "".join(f"{codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3]:02x}" for i in range(0, 128, 4))
    return f"{min(255, round(math.log(len(raw) + 1) / math.log(1.3))):02x}{digits}", codes


@pytest.mark.parametrize("text", [*texts(12, 7), *ODD])
def test_digest_equals_a_plain_count(text):
    mark, codes = plain_digest(text)
    assert fingerprint.digest(text) == mark
    other, other_codes = plain_digest("another text of some words")
    apart = sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(codes, other_codes)) + 2 * min(12, abs(int(mark[:2], 16) - int(other[:2], 16)))
    assert fingerprint.likeness(mark, other) == pytest.approx(1 - apart / (6 * 128 + 24))


# ---- language ID


def test_logits_equal_a_plain_average():
    rows = language_rows(60)
    model = langid.fit([r[1] for r in rows], [r[2] for r in rows])
    for text in (rows[0][1], "a", "Ünï 12 ings", "th" * 500):
        raw = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in f" {text} ".lower().encode())
        ids = []
        for n, (add, xor, times) in {2: (0, 0, 2654435761), 3: (0x9E3779B9, 0, 2246822519), 4: (0, 0x85EBCA6B, 3266489917)}.items():
            for i in range(len(raw) - n + 1):
                ids.append((((int.from_bytes(raw[i : i + n]) + add) % 2**32 ^ xor) * times % 2**32) >> 16)
        assert np.allclose(model.logits(text), np.mean([model.table[i] for i in ids], axis=0) + model.bias, atol=1e-4)


def test_rejection_and_odd_rows(spark):
    rows = language_rows(300)
    model = langid.train(documents(spark, rows))
    odd = [(900, "日本語 テキスト です " * 30, None), (901, rows[0][1] * 400, None), (902, rows[0][1], None), (902, rows[0][1], None)]
    found = langid.identify(documents(spark, odd), model).select("doc_id", "language.*").collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == 4 and not by_id[900]["accepted"] and by_id[901]["accepted"] and by_id[901]["lang"] == by_id[902]["lang"] == rows[0][2]
    with pytest.raises(ValueError, match="language"):
        langid.identify(documents(spark, odd).withColumn("Language", F.lit(1)), model)


# ---- HTML extraction


def plain_stretches(weight):
    """Lines that count, and lines between two that do with less than a window of others between them."""
    heavy = [i for i, w in enumerate(weight) if w]
    kept = set(heavy)
    for a, b in zip(heavy, heavy[1:]):
        if b - a <= extract.WINDOW:
            kept.update(range(a, b))
    return sorted(kept)


def test_stretches_equal_plain_windows():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 5, 40, 200] * 20:
        weight = [rng.choice([0, 0, 0, 1, 7]) for _ in range(n)]
        found = extract.stretches(weight)
        assert [i for a, b in found for i in range(a, b)] == plain_stretches(weight)
        assert all(sum(weight[b : b + extract.WINDOW]) == 0 and weight[a] and weight[b - 1] for a, b in found)


UNMARKED = "<body><ul><li><a>Home</a><li><a>News</a><li><a>Shop</a></ul><h1>Head</h1><div class=share-bar>tw</div><p><a href=x>A paragraph that is a link</a></p><p>{}</p><div class='ad box'>Buy</div><p>Ok.</p><div class=advert>Buy</div><p>Last paragraph.</p><ul><li><a>1</a><li><a>2</a><li><a>3</a></ul><div id='comments'><p>Nice!</p></div>"


def test_stretches_choose_the_text():
    long_ = "long text " * 80
    assert extract.main_text(UNMARKED.format(long_)) == f"Head A paragraph that is a link {long_.strip()} Ok. Last paragraph."
    for page in (UNMARKED.format(long_), PAGE):
        everything = " ".join(line[0] for line in extract.lines_of(page)[0] if line[0])
        assert extract.main_text(page) != everything and set(extract.main_text(page).split()) <= set(everything.split())
    assert extract.main_text("<article><p>E = <math><mi>m</mi><mo>c</mo></math> holds</p><p class='share-price'>Price</p><div class='share-bar'>x</div>") == "E = mc holds Price"


def test_very_long_and_deep_pages(spark):
    long_ = "<article>" + "<p>word</p>" * 60_000
    pages = spark.createDataFrame([(1, long_), (2, "<b>" * 20_000 + "<div>" * 20_000 + "</b>" * 20_000 + "x")], "page_id long, html string")
    assert {r["page_id"]: len(r["t"]) for r in extract.extract_pages(pages, "t").collect()} == {1: 5 * 60_000 - 1, 2: 1}
    with pytest.raises(ValueError, match="html"):
        extract.extract_pages(pages, "html")


# ---- sharding and mixing


def write_documents(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    return docs


def test_sharding_query_on_odd_texts(spark, tmp_path):
    write_documents(spark, tmp_path, [(i, t, None, None, 0) for i, t in enumerate([*ODD, *ODD, *texts(100)])])
    found = queries.op5_sharding(spark, str(tmp_path)).collect()
    sizes = Counter(r["shard"] for r in found)
    assert len(found) == 116 and max(sizes.values()) - min(sizes[s] for s in range(40)) <= 1
    assert {r["doc_id"]: r["size"] for r in found}[0] == 16 and {r["doc_id"]: r["text_crc32"] for r in found}[1] == 0


def test_cut_documents_reach_every_target(spark):
    rng = random.Random(5)
    rows = [(i, t, None, "a" if i % 3 == 0 else rng.choice("bcdef")) for i, t in enumerate(texts(400))] + [(1000, "word " * 20_000, None, "d"), (1001, None, None, None), (1002, "x y", None, None), (3, "again", None, "b"), (3, "again", None, "b")]
    docs = documents(spark, rows)
    found = mixing.mix(docs, cut=True).collect()
    source, sizes, taken, target = {(r[0], len((r[1] or "").split())): r[3] for r in rows}, Counter(), Counter(), {}
    for r in found:
        s = source[r["doc_id"], r["size"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    expected = water_fill(dict(sizes))
    assert all(target[s] == pytest.approx(expected[s]) and abs(taken[s] - target[s]) <= 10 for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(5), cut=True).collect()))
    kept = mixing.copies(docs.withColumn("often", F.lit("o")).withColumn("draw", F.lit(1)), mixing.mix(docs))
    assert kept.columns[-2:] == ["often", "draw"] and kept.count() > 0


# ---- WARC


def test_archives_of_bounded_size_and_one_hot_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    hot, long_ = "same " * 100, "".join(chr(33 + i * 7919 % 90) for i in range(300_000))
    rows = [(i, f"u{i}", hot if i % 3 else f"page {i} " * 40) for i in range(600)] + [(1000, "l", long_), (1001, "m", long_)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    warc.write_archives(pages, folder)
    archives = list((tmp_path / "w").glob("*.warc.gz"))
    assert len(archives) > 4 and sorted(a.stat().st_size for a in archives)[-2] < 40_000
    first = gzip.open(archives[0]).read()
    assert archives[0].read_bytes().count(b"\x1f\x8b\x08") >= first.count(b"WARC/1.0\r\n") > 0
    (tmp_path / "w" / "lost.warc.gz").write_bytes(b"what a lost task left")
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.resolve(warc.read_archives(spark, folder)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    least = min(i for i, _, t in rows if t == hot)
    assert found == {i: ("response", None, sha(t)) if t not in (hot, long_) or i in (least, 1000) else ("revisit", least if t == hot else 1000, sha(t)) for i, _, t in rows}


# ---- URL filters


def test_distrust_reaches_hosts_far_from_a_seed(spark):
    rows = [(0, "http://bad.net/", "")] + [(i, f"http://h{i}.com/", f'<a href="http://{"bad.net" if i == 1 else f"h{i - 1}.com"}/">') for i in range(1, 20)]
    rows += [(100, "http://hub.com/", "".join(f'<a href="http://leaf{i}.com/">' for i in range(200))), (101, "http://hub.com/", None), (101, "http://hub.com/", None), (102, "http://x.com/" + "p" * 100_000, ""), (103, "http://" + "h" * 50_000 + ".net/", None)]
    found = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rank", F.lit("clash"))).collect()
    verdict = {r["page_id"]: r["verdict"] for r in found}
    assert len(found) == len(rows) and all(verdict[i] == "block" for i in range(20)) and verdict[100] == verdict[101] == verdict[102] == "allow" and verdict[103] == "block"
    total = {r["page_id"]: r["distrust"] for r in found}
    assert total[19] == pytest.approx(total[0] * 0.85**19)


# ---- near-duplicates


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 90, 110, 400, 3000) for _ in range(6)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.92)], rng.integers(0, 1 << 63, max(0, int(len(s) * 0.06))).astype(np.uint64)])) for s in sets]
    import pyarrow as pa

    sketches = simhash.Sketches(pa.chunked_array([pa.array([simhash.odd_sketch(s) for s in sets], pa.binary())]))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    size = np.array([len(s) for s in sets])
    near = np.minimum(size[a], size[b]) >= 0.8 * np.maximum(size[a], size[b])
    a, b = a[near], b[near]
    kept = set(sketches.may_reach(a, b, size, 0.8).tolist())
    similar = {i for i, (x, y) in enumerate(zip(a, b)) if len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))}
    assert similar <= kept and len(similar) > len(sets) and len(kept) < len(a) / 4


def crowd(n, seed=12):
    """Near copies of one text, of a similarity from about 0.6 to 1 to it, and so of less to each other."""
    rng = random.Random(seed)
    base = [f"{rng.choice(WORDS)}{k}" for k in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(120), rng.choice((1, 2, 2, 3, 4, 5, 6))):
            w[k] = f"y{rng.randint(0, 99)}"
        out.append(" ".join(w))
    return out


def test_groups_of_a_crowd_are_those_of_all_pairs(spark, monkeypatch):
    """With fingerprints in number enough that every pair meets, the groups are those of all pairs."""
    monkeypatch.setattr(simhash, "RECALL", 0.999999)
    monkeypatch.setattr(simhash.tables_for, "__defaults__", (0.999999,))
    rows = list(enumerate(crowd(700)))
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    found = dict(map(tuple, simhash.similar_groups(documents(spark, rows)).collect()))
    assert found == {i: find(i) for i in range(len(rows))} and 1 < len(set(found.values())) < len(rows)


def test_keep_one_loses_no_text(spark):
    a, b, c, d = ("alpha beta gamma delta", "one two three four", "red green blue white", "up down left right")
    docs = documents(spark, [(None, a), (None, b), (7, c), (7, d), (7, d), (8, c)]).withColumn("row_key", F.lit("clash"))
    for groups in (simhash.near_duplicates(docs, max_bits=2), simhash.similar_rows(docs)):
        kept = simhash.keep_one(docs, groups)
        assert kept.columns == docs.columns and sorted((r["text"] for r in kept.collect())) == sorted([a, b, c, d])


def test_near_duplicates_with_one_text_in_a_third_of_the_rows(spark):
    rows = [(i, "the very same text of some words" if i % 3 == 0 else f"{t} {i}") for i, t in enumerate(texts(600))]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert all(found[i] == 0 for i in range(0, 600, 3)) and len(found) == 600


# ---- the pipeline


def test_pipeline_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
        assert docs.count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, very long texts and columns with clashing names."""
    rows = language_rows(120)
    rows = [(i, t, lang, "a", len(t)) for i, t, lang in rows] + [(i, t, lang, "a", len(t)) for i, t, lang in rows[:3]]
    rows += [(None, rows[5][1] + " other ending", "en", None, None), (500, "the ring and " * 60_000, "en", "b", None), (501, None, None, None, None), (502, "", "fr", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("language", "row_key", "often", "draw", "turn", "fp", "cls", "decoded"):
        docs = docs.withColumn(name, F.lit("clash"))
    columns, before = docs.columns, {(r["doc_id"], r["text"]) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, "unused"), "odd-stage")
        assert docs.columns == columns and {(r["doc_id"], r["text"]) for r in docs.collect()} <= before
    kept = [(i, t) for i, t in before if t and t.strip()]
    groups = brute_similar([(i if i is not None else 10**9, t) for i, t in kept])
    expected = defaultdict(set)
    for (i, t), g in zip(kept, groups):
        expected[g].add(t)
    assert len({r["text"] for r in docs.collect()}) <= len(expected)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, "unused")
    assert tokens.count() == docs.count()
