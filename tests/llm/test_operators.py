"""Each operator against a brute-force version, and on nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from assayer.llm import bpe, extract, fingerprint, langid, mixing, sharding, simhash, topk, urlfilter, warc

WORDS = "the of and to in that is was for on river stone lamp garden über éclair naïve 42 x".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def documents(spark, rows, schema="doc_id long, text string, lang string, source string, shard string, pid int"):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], schema)


ODD = [None, "", " \t\n", "a", "!!! 123", "\U0001f600 é\u0301", "x" * 100_000, "word " * 20_000]


# ---- top-k


def brute_topk(rows, k=5):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault((i, tuple(math.floor(256 * float(np.float32(x))) for x in v)), None)
    out = {}
    for i, v in vectors:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vectors if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return {i: v for i, v in out.items() if v}


def run_topk(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("cb", F.lit(1))
    found = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return dict(found)


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SLICE", 16)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, rng.uniform(0.1, 2), 8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 520)]  # a hot vector: ties
    rows += [(520, None), (521, []), (522, [1.0, None] + [0.0] * 6), (523, [float("nan")] * 8), (524, [float("inf")] * 8), (None, rows[0][1]), (5, rows[5][1])]
    assert run_topk(spark, rows) == brute_topk(rows)


def test_topk_small_and_empty(spark):
    assert run_topk(spark, []) == {}
    assert run_topk(spark, [(0, [1.0, 2.0])]) == {}
    assert run_topk(spark, [(0, [1.0, 2.0]), (1, [1.0]), (2, [-0.001, 0.0])]) == {0: [(2, -256)]}


def test_topk_large_components(spark):
    rows = [(0, [1e10, 1.0]), (1, [1e10, 1.0]), (2, [1e3, 7.0]), (3, [1e3, 9.0])]
    found = run_topk(spark, rows)[0]
    assert [f[0] for f in found] == [1, 3, 2] and found[0][1] == 2**63 - 1


# ---- fingerprints


def test_edited_fingerprints(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts(60) + ODD)]
    random.Random(5).shuffle(rows)
    found = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(documents(spark, rows).repartition(3)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(found) == len(rows)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.digest(t), fingerprint.digest(edited))
        assert r["near_next"] == pytest.approx(fingerprint.likeness(fingerprint.digest(t), fingerprint.digest(after)))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_fingerprints_small_tables(spark):
    assert fingerprint.edited_fingerprints(documents(spark, [])).count() == 0
    one = fingerprint.edited_fingerprints(documents(spark, [(None, "abcd")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.edited_fingerprints(documents(spark, [(1, "a"), (1, "a"), (1, "b")])).count() == 3


def test_digest_is_stable_over_chunks(monkeypatch):
    text = " ".join(texts(50))
    whole = fingerprint.digest(text)
    monkeypatch.setattr(fingerprint, "CHUNK", 100)
    assert fingerprint.digest(text) == whole
    assert fingerprint.likeness(whole, whole) == 1.0
    assert fingerprint.likeness(whole, fingerprint.digest("")) >= 0.0


# ---- language ID

SYLLABLES = {"en": ["th", "er", "ing", "and"], "fr": ["eau", "ou", "ez", "é"], "de": ["sch", "ung", "ein", "ü"]}


def language_rows(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(30)), lang))
    return out


def test_languages_of_held_out_rows(spark):
    rows = language_rows(300)
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "fr"), (1003, "thering", None), (None, "einung schung", "de")]
    docs = documents(spark, rows + extra)
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out))
    assert model.labels == ["de", "en", "fr"]
    found = langid.identify(docs, model).select("doc_id", "text", "lang", out.alias("out"), F.col("language.lang").alias("pred"), "language.score", "language.accepted").collect()
    assert len(found) == len(rows) + len(extra)
    held = [r for r in found if r["out"]]
    assert all(r["out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert sum(r["pred"] == r["lang"] for r in held if (r["doc_id"] or 0) < 1000) >= 0.98 * sum((r["doc_id"] or 0) < 1000 for r in held)
    und = {r["doc_id"]: r for r in found if r["pred"] == "und"}
    assert set(und) == {1000, 1001, 1002} and all(r["score"] == 0.0 and not r["accepted"] for r in und.values())
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_without_labels(spark):
    docs = documents(spark, [(1, "some text"), (2, None)])
    assert langid.train(docs) is None
    assert [r["language"]["lang"] for r in langid.identify(docs, None).collect()] == ["und", "und"]
    assert langid.identify(documents(spark, []), None).count() == 0


def test_language_logits_over_chunks(monkeypatch):
    rows = language_rows(40)
    model = langid.fit([r[1] for r in rows], [r[2] for r in rows])
    text = " ".join(r[1] for r in rows)
    whole = model.logits(text)
    monkeypatch.setattr(langid, "CHUNK", 500)
    assert np.allclose(model.logits(text), whole, atol=0.05)


# ---- HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- note --><div id="cookie-notice">We use cookies</div>
<article><h1>The &amp; Title</h1><p><b>First&nbsp;part<br>goes   on <a href="x">with a link</a>.<p>Tiny.</p><div class="ad">Buy this</div><p>Last &lt;part&gt; of it.</p>
<section class="comments"><article><p>Reader comment</p></article></section></article>
<aside>Side</aside><form><p>Subscribe<input></form><footer>&copy; f</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE) == "The & Title First part goes on with a link . Tiny. Last <part> of it." or extract.main_text(PAGE) == "The & Title First part goes on with a link. Tiny. Last <part> of it."
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav>x</nav>") == ""
    assert extract.main_text("just text &amp; more") == "just text & more"
    assert extract.main_text("<div><p>One paragraph of the story that is long.</p><p>Short.</p></div><div class='sidebar'>no</div>") == "One paragraph of the story that is long. Short."
    assert extract.main_text("<p>" * 3000 + "deep") == "deep"
    assert extract.main_text("<article><p>cut off <b") == "cut off"
    assert extract.main_text("<body class='sidebar'><div class='layout has-sidebar'><p>Story</p><div class='sidebar'>no</div></div>") == "Story"
    assert extract.main_text("<article><header class='entry-header'><h1>Head</h1></header><p>Text</p><footer>by me</footer></article><header>Site</header>") == "Head Text"
    assert extract.main_text("<div class='widget'><p>All that there is</p></div>") == "All that there is"


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x")], "page_id long, url string, html string, text string")
    found = extract.extract_pages(pages).collect()
    assert [len(r["main_text"]) > 0 for r in sorted(found, key=lambda r: r["page_id"])] == [True, True, False, False]
    assert extract.extract_pages(pages.limit(0)).count() == 0


# ---- sharding


@pytest.mark.parametrize("n", [0, 1, 39, 40, 1000])
def test_shards_are_exact(spark, n):
    rows = documents(spark, [(i // 2, "t", None, None, "clash", 3) for i in range(n)]).repartition(5)
    found = sharding.shuffle_to_shards(rows).collect()
    sizes = Counter(r["shard"] for r in found)
    assert len(found) == n and sorted(r["doc_id"] for r in found) == sorted(i // 2 for i in range(n))
    assert all(n // 40 <= sizes[s] <= -(-n // 40) for s in range(40))
    for s in range(40):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))


def test_communication_matrix():
    counts = [0, 7, 100, 3, 1]
    m = sharding.communication_matrix(counts, 6, 1)
    assert [sum(line) for line in m] == counts
    assert [sum(c) for c in zip(*m)] == [19, 19, 19, 18, 18, 18]
    mean = np.mean([sharding.communication_matrix([10, 30], 4, s)[0] for s in range(400)], axis=0)
    assert np.allclose(mean, 2.5, atol=0.25)


# ---- mixing


def water_fill(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        rest, open_ = budget - sum(cap * sizes[s] for s in capped), [s for s in names if s not in capped]
        target = {s: cap * sizes[s] for s in capped} | {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > cap * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mix(spark):
    rng = random.Random(4)
    sources = ["a", "B", "é", None, "z", "\U0001f600", ""]
    rows = [(i, t, None, "a" if i % 3 == 0 else rng.choice(sources)) for i, t in enumerate(texts(600) + ODD[:6])]
    rows += rows[5:8]
    docs = documents(spark, rows)
    found = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    count = lambda t: len(re.findall(mixing.WORD, t or ""))
    assert sorted((r["doc_id"], r["size"]) for r in found) == sorted((r[0], count(r[1])) for r in rows)
    source_of, sizes, taken, target, longest = {r[0]: r[3] for r in rows}, Counter(), Counter(), {}, Counter()
    for r in found:
        s = source_of[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        longest[s] = max(longest[s], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    expected = water_fill(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(expected[s]) and abs(taken[s] - target[s]) <= 2 * max(longest.values())
        assert all(r["source_size"] == sizes[s] for r in found if source_of[r["doc_id"]] == s)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_mix_odd_tables(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    (one,) = mixing.mix(documents(spark, [(1, None, None, "a")])).collect()
    assert (one["size"], one["taken"], one["target"]) == (0, 0, 0.0)
    (one,) = mixing.mix(documents(spark, [(1, "a b c d", None, None)])).collect()
    assert one["target"] == 6.0 and one["taken"] in (4, 8)
    docs = documents(spark, [(i, t, None, "a") for i, t in enumerate(texts(50))])
    kept = mixing.copies(docs, mixing.mix(docs))
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["taken"]}


# ---- WARC


def test_archives_round_trip(spark, tmp_path):
    long_ = "<p>" + "é" * 80 + "</p>\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"
    rows = [(5, "http://a/x y", long_), (2, "http://b", long_), (9, None, long_), (2, "http://b", long_), (7, "u\r\nX: y", None), (8, "u", ""), (11, "u", "short"), (12, "u", "short"), (None, "n", long_), (13, "v", "other " * 50)]
    pages = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w"))
    found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolve(records).collect()]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    expected = [(2, "response", None), (2, "revisit", 2), (5, "revisit", 2), (9, "revisit", 2), (None, "revisit", 2)]
    expected = [(i, size(long_), sha(long_), kind, ref) for i, kind, ref in expected]
    expected += [(i, size(t), sha(t), "response", None) for i, t in ((7, None), (8, ""), (11, "short"), (12, "short"), (13, "other " * 50))]
    assert sorted(found, key=str) == sorted(expected, key=str)
    ids = [r["record_id"] for r in records.collect()]
    assert len(set(ids)) == len(ids) == len(rows)
    assert sorted(bytes(r["payload"]).decode() for r in records.where("record_type = 'response'").collect()) == sorted([long_, "", "", "short", "short", "other " * 50])


def test_archives_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.resolve(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0


# ---- BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_tiktoken_and_round_trips(spark, ranks, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(bpe, "SLICE", 50)
    rows = [(i, t) for i, t in enumerate(texts(80) + ODD + ["<|endoftext|> it's  we'll\n\n  x", "\u3000\u00a0 \x00\x1f", "日本語 テキスト"])]
    rows += [(3, rows[3][1]), (None, "null id")]
    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, rows).repartition(3).persist()
    docs.count()
    found = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    expected = sorted(((i, one.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in found), key=str) == expected
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)
    both = bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_bytes=True).collect()
    assert sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in both), key=str) == expected
    assert bpe.decode(spark.sql("select cast(null as array<int>) ids"), ranks).first()["decoded"] is None
    assert bpe.encode(documents(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


# ---- URL filters


def test_rules_and_hosts(spark):
    urls = ["http://A.Net/x", "https://www.example.net/en/1?q#f", "http://example.net", "http://notexample.net/en/", "http://example.com/de/a", "http://m.example.com/fr/", "x://example.org/fr/1", "http://org/fr/", "nothing", None, "http://a.com?x=http://b.net/", "http://net#x", "http://b.net/", "http://ünï.org/fr/é"]
    pages = spark.createDataFrame([(i, u, None, "c") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages).collect()}
    assert [found[i] for i in range(len(urls))] == [
        ("a.net", "/x", "net/", "block"), ("www.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "", None, "allow"), ("notexample.net", "/en/", "net/", "block"),
        ("example.com", "/de/a", "example.com/de/", "block"), ("m.example.com", "/fr/", None, "allow"), ("example.org", "/fr/1", "org/fr/", "allow"), ("org", "/fr/", "org/fr/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.com", "", None, "allow"), ("net", "", None, "allow"), ("b.net", "/", "net/", "block"), ("ünï.org", "/fr/é", "org/fr/", "allow"),
    ]


def test_ranks_and_verdicts_by_links(spark):
    link = lambda *hosts: "".join(f'<a class=x href="//{h}/p">t</a>' for h in hosts)
    rows = [(1, "http://bad.net/", link("bad2.net")), (2, "http://farm.com/", link("bad.net", "bad.net", "bad2.net")), (3, "http://feeder.com/x", link("farm.com")), (4, "http://good.org/fr/1", link("liked.com", "feeder.com")), (5, "http://liked.com/", link("good.org")), (6, "http://alone.com/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["host"]: r for r in urlfilter.judge(pages).collect()}
    verdict = {h: r["verdict"] for h, r in found.items()}
    assert verdict == {"bad.net": "block", "farm.com": "block", "feeder.com": verdict["feeder.com"], "good.org": "allow", "liked.com": "allow", "alone.com": "allow"}
    edges = Counter()
    for _, url, page in rows:
        src = url.split("/")[2]
        for dst in set(re.findall(r"//([^/]+)", page or "")) - {src}:
            edges[src, dst] += 1

    def rank(links, seeds):
        total, out = sum(seeds.values()), Counter()
        for (a, _), n in links.items():
            out[a] += n
        now = {h: 0.15 * w / total for h, w in seeds.items()}
        start = dict(now)
        for _ in range(urlfilter.ROUNDS):
            after = Counter(start)
            for (a, b), n in links.items():
                after[b] += 0.85 * now.get(a, 0) * n / out[a]
            now = after
        return now

    trust = rank({e: n for e, n in edges.items() if e[1] != "bad.net"}, {"good.org": 1})
    distrust = rank({(b, a): n for (a, b), n in edges.items() if a != "good.org"}, {"bad.net": 1})
    for h, r in found.items():
        assert (r["trust"], r["distrust"]) == (pytest.approx(trust.get(h, 0)), pytest.approx(distrust.get(h, 0)))


def test_url_filter_of_no_pages(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- SimHash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], d)
    return [least[find(i)] for i in range(len(fps))]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    base = texts(60)
    near = [t + " tail" for t in base if len(t) > 200] + [t.upper() for t in base[:20]]
    rows = [(i * 2, t) for i, t in enumerate(base + near + base[:15] + ODD)]
    rows.append(rows[4])
    found = sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    rows = sorted(rows, key=lambda r: r[0])
    fps = [brute_fingerprint(t) for _, t in rows]
    assert [f[:2] for f in found] == list(zip([r[0] for r in rows], fps))
    assert [f[2] for f in found] == brute_components(fps, [r[0] for r in rows])


@pytest.mark.parametrize(("cell", "sort"), [(1 << 20, 1 << 22), (2000, 5000)])
def test_ball_links_find_every_near_pair(spark, monkeypatch, cell, sort):
    monkeypatch.setattr(simhash, "CELL_VARIANTS", cell)
    monkeypatch.setattr(simhash, "SORT_VARIANTS", sort)
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 4 for r in links.collect())
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    found = [roots.get(s, s) for s in signed]
    expected = brute_components(fps, range(len(fps)))
    group = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == v) for v in set(labels))
    assert group(found) == group(expected)


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert roots == {i: 0 for i in range(n + 1)} | {500: 500, 501: 500}


def test_keep_one(spark):
    docs = documents(spark, [(3, "a b c d e"), (1, "a b c d e"), (2, "w x y z"), (2, "w x y z"), (None, "q r s t"), (9, None), (8, "")])
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 8, None]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def brute_similar(rows, at=0.8):
    sets, ids = [], []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()})
        ids.append(i)
    near = [[j for j in range(len(ids)) if len(sets[i] & sets[j]) >= at * len(sets[i] | sets[j])] for i in range(len(ids))]
    out = list(range(len(ids)))
    for i in range(len(ids)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = min(ids[j] for j in seen)
    return out


def test_similar_groups(spark):
    rng = random.Random(6)
    base = [" ".join(f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(200)) for _ in range(30)]

    def edited(t, n):
        w = t.split()
        for i in rng.sample(range(len(w)), n):
            w[i] = "changed"
        return " ".join(w)

    rows = list(enumerate(base + [edited(t, 2) for t in base] + [edited(t, 30) for t in base] + [base[0].upper(), base[0], None, "", " ", "one", "one two", "one two"]))
    rows.append(rows[3])
    found = sorted((r["doc_id"], r["component_id"]) for r in simhash.similar_groups(documents(spark, rows)).collect())
    rows = sorted(rows, key=lambda r: r[0])
    assert found == list(zip([i for i, _ in rows], brute_similar(rows)))
    assert simhash.similar_groups(documents(spark, [])).count() == 0


@pytest.mark.parametrize("width", [32, 40, 46, 52])
def test_tables_hold_recall(width):
    """Pairs of equal sets at 0.8 meet as often at the widths of larger inputs."""
    rng = np.random.default_rng(3)
    tables = simhash.tables_for(width, 2, simhash.SIMILARITY, simhash.TABLES)
    met = 0
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        a, b = (np.array(simhash.short_fingerprints(y, tables, width)) for y in (x[:900], x[100:]))
        met += (np.bitwise_count(a ^ b) <= 4).any()
    assert met >= 0.96 * 400
    assert tables >= simhash.TABLES


def test_similar_groups_makes_tables_for_the_width(spark, monkeypatch):
    asked = []

    def stop(classes, n, width, radius):
        asked.append((width, classes.select(F.size("fps")).first()[0]))
        raise InterruptedError

    monkeypatch.setattr(simhash, "_meetings", stop)
    with pytest.raises(InterruptedError):
        simhash.similar_groups(spark.range(1 << 16).selectExpr("id as doc_id", "concat('w', id) as text"))
    assert asked == [(38, 12)]


def test_similar_groups_in_a_crowd(spark):
    """In a crowd without its original, every pair that meets is held against whole sets."""
    rng = random.Random(11)
    base = [f"{rng.choice(WORDS)}{k}" for k in range(100)]
    rows = []
    for i in range(600):
        w = list(base)
        for k in rng.sample(range(100), rng.choice((2, 2, 3, 4))):
            w[k] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    sets = [simhash.shingle_set(t, 5) for _, t in rows]
    fps = np.array([simhash.short_fingerprints(x, simhash.TABLES, 32) for x in sets])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero((np.bitwise_count(fps[i] ^ fps[:i]) <= 4).any(1)).tolist():
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    found = sorted(map(tuple, simhash.similar_groups(documents(spark, rows)).collect()))
    assert found == [(i, find(i)) for i in range(len(rows))]
