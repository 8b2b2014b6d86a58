"""Clustering, conversation repair and sorted passes against plain versions, and on odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import clustering, passes, repair

# ---- clustering


def brute_clusters(rows, dimensions, clusters, rounds, scale=64, seed=1):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(x) * scale <= clustering.LARGEST for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:clusters]]
    if not centroids:
        return []
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = defaultdict(list)
        for (_, k), (_, v) in zip(assign(), kept):
            own[k].append(v)
        centroids = [[sum(x) // len(own[k]) for x in zip(*own[k])] if own[k] else c for k, c in enumerate(centroids)]
    found, inertia = assign(), defaultdict(int)
    for d, k in found:
        inertia[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for (i, _), (d, k) in zip(kept, found)), key=repr)


def run_clusters(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    out = clustering.cluster(df, **kw)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("clusters", [1, 5, 16])
def test_clusters_equal_brute_force(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(0, 1, (4, 20)) * np.linspace(3, 0.05, 20)
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.3, 20)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(150)]  # a hot vector
    rows += [(5, rows[5][1]), (6, rows[9][1]), (None, rows[3][1]), (None, None), (900, None), (901, []), (902, [1.0] * 19), (903, [float("nan")] * 20), (904, [float("inf")] * 20), (905, [None] * 20), (906, [3e38] * 20)]
    assert run_clusters(spark, rows, clusters=clusters, dimensions=20) == brute_clusters(rows, 20, clusters, 3)


def test_clusters_of_few_rows(spark):
    assert run_clusters(spark, []) == []
    assert run_clusters(spark, [(None, [0.0] * 64)]) == []
    rows = [(1, [0.5] * 64), (2, [0.5] * 64)]
    assert run_clusters(spark, rows) == brute_clusters(rows, 64, 16, 3)


def test_nearest_abandons_only_the_farther(monkeypatch):
    rng = np.random.default_rng(2)
    x, c = rng.integers(-40, 40, (500, 64)), rng.integers(-40, 40, (16, 64))
    c[9], c[12] = c[3], x[7]
    x[:50] = c[3]
    number, distance = clustering.nearest(x, c, rng.permutation(64))
    full = np.square(x[:, None] - c[None]).sum(2)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()


# ---- conversations

SPACE = "[\x20\x09-\x0d]"


def next_roles(state):
    return {"": "u", "s": "u", "u": "a", "a": "u"}[state]


def cheapest(turns):
    """Least (cost, audit, lines) by a search over all edits; turns: role, text, fault."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(turns) and state in ("", "a"):
            return cost, audit, lines
        if (at, state) in done:
            continue
        done.add((at, state))
        want = next_roles(state)
        name = {"u": "user", "a": "assistant"}[want]
        heapq.heappush(heap, (cost + 5, audit + "I", at, want, (*lines, f"{name}:")))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, lines))
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, want, (*lines, f"{name}:{text}")))
                if role[:1] == want or state == "" and role[:1] == "s":
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))
    raise AssertionError


def brute_repair(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        seen, marked = set(), []
        for _, _, role, text in turns:
            body = re.sub(f"{SPACE}+\\Z", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        known = [t for some, t, _, _ in turns if some]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        faults = [sum(f == x for _, _, f in marked) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string"


def as_results(found):
    out = {}
    for r in found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect():
        assert r["conv_id"] not in out
        out[r["conv_id"]] = tuple(r)[1:]
    return out


def some_turns(n, most, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Sam"])
            text = rng.choice(["Yes.", "No!", "Why? ", "so", "", " \t", None, "A b", "é.", f"Turn {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


def test_repair_equals_a_search_over_all_edits(spark):
    rows = some_turns(150, 9, 4) + [(None, 1, "user", "Hello."), (None, 2, "assistant", "Yes."), (None, 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, TURNS).withColumn("fault", F.lit("clash")).withColumn("times", F.lit(9))
    assert as_results(repair.repair(df)) == brute_repair(rows)


@pytest.mark.parametrize("block", [1, 3, 7])
def test_repair_in_blocks_is_the_same(spark, block):
    rows = some_turns(12, 30, block) + [(99, None, "user", "Again.")] * 20 + [(99, t, "assistant", "Again.") for t in range(10)] + [(98, 1, "user", "")] * 9
    df = spark.createDataFrame(rows, TURNS)
    assert as_results(repair.repair(df, block_turns=block)) == brute_repair(rows)


def test_repair_of_a_hot_conversation(spark):
    rows = [(7, t, ("user", "assistant")[t % 2 if t % 11 else 0], f"Turn {t % 400}" + "." * (t % 5 > 0)) for t in range(1500)] + some_turns(30, 4, 9)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    found = as_results(repair.repair(df, block_turns=100))
    expected = brute_repair([r for r in rows if r[0] == 7])[7]
    assert found[7] == expected


def test_damaged_conversations(spark):
    rows = [(c, t, ("system", "user", "assistant")[0 if t == 0 and c % 3 == 0 else 1 + t % 2], f"Text {t} of {c}. Well?") for c in range(120) for t in range(1 + c % 7)]
    rows += [(None, None, None, None), (500, None, "user", "x" * 50_000 + ".")]
    hurt = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        hurt += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    expected = brute_repair(hurt)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = as_results(repair.repaired_damage(spark.createDataFrame(rows, TURNS)))
    assert found == {c: expected.get(c, none) for c, *_ in rows}
    assert none in found.values()


def test_no_conversations(spark):
    assert as_results(repair.repaired_damage(spark.createDataFrame([], TURNS))) == {}


def test_blocks_join_to_what_the_whole_gives():
    rng = random.Random(3)
    for _ in range(200):
        turns = [(rng.choice("usax"), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randint(0, 12))]
        whole = repair.parse(turns)
        at = rng.randint(0, len(turns))
        best = {}
        for state, (cost, audit) in repair.parse(turns[:at]).items():
            for end, (more, rest) in repair.parse(turns[at:], state).items():
                best[end] = min(best.get(end, (10**9, "")), (cost + more, audit + rest))
        assert best == whole


# ---- sorted passes


def brute_near(rows, cosine=0.98):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    unit = {i: v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for i, v in unit.items()}
    near = defaultdict(set)
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                near[a].add(b)
    root = list(range(len(rows)))
    place = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        first = min(seen, key=place)
        root[i] = rows[first][0]
        out.append((rows[i][0], len(near[i]), root[i], rows[i][0] == root[i]))
    return sorted(out, key=repr)


def run_near(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    out = passes.near_copies(df, **kw)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(seed, n=300, d=24):
    """Singles, copies, near copies at all distances around the threshold, and a crowd."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 1, d).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]
    base = np.array(rows[3][1])
    for i in range(120):  # a crowd
        rows.append((1000 + i, (base + rng.normal(0, 0.1, d)).astype(np.float32).tolist(), rows[3][2]))
    for i in range(100):  # pairs
        other = np.array(rows[10 + i][1])
        rows.append((2000 + i, (other + rng.normal(0, 0.05 + 0.25 * rng.random(), d)).astype(np.float32).tolist(), rows[10 + i][2]))
    rows += [(3000 + i, rows[4][1], rows[4][2]) for i in range(200)]  # copies
    rows += [(4000, rows[4][1], None), (4001, rows[4][1], 9), (4002, (np.array(rows[4][1]) * 1e-30).astype(np.float32).tolist(), rows[4][2]), (4003, (np.array(rows[4][1]) * 1e37).astype(np.float32).tolist(), rows[4][2])]
    return rows


def test_passes_equal_all_pairs(spark):
    rows = vectors(1)
    assert run_near(spark, rows) == brute_near(rows)


def test_passes_on_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, -0.0], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [None, 1.0], 0), (7, v, None), (8, v, None), (9, v, 1), (10, v, 1), (None, v, 1), (10, v, 1), (None, [1.0], 2), (None, None, None), (11, [1.0, 2.0], 1), (12, [-0.0, 1.0], 3), (13, [0.0, 1.0], 3)]
    found = run_near(spark, rows)
    expected = [(i, n, c, k if i is not None else c is None) for i, n, c, k in brute_near(rows)]
    assert found == sorted(expected, key=repr)
    assert run_near(spark, []) == []


def test_counts_in_blocks(spark):
    rows = [r for r in vectors(5, 60) if r[0] < 1120]
    unit = np.array([np.array(r[1], float) / np.linalg.norm(r[1]) for r in rows])
    members = spark.createDataFrame([(i, r[2], 1 + i % 3, r[1]) for i, r in enumerate(rows)], "cls long, root long, copies long, embedding array<float>")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    found = {r["cls"]: r["linked"] for r in passes.counted(members, sizes, 0.98, block=7).collect()}
    for i in range(len(rows)):
        near = [j for j in range(len(rows)) if j != i and rows[j][2] == rows[i][2] and unit[i] @ unit[j] >= 0.98]
        assert found[i] == sum(1 + j % 3 for j in near)


def test_passes_follow_the_rows():
    assert passes.passes_for(1, 0.98, 32) == passes.LEAST_PASSES
    for n in (10**4, 10**6, 10**9):
        first = math.log2(n / 32) + 1
        missed = (1 - (1 - passes.split_chance(0.98)) ** first) ** passes.passes_for(n, 0.98, 32)
        assert missed <= 0.001
    assert 12 <= passes.most_differing(0.98) <= 20
