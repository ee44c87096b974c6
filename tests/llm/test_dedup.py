import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossalith.llm import odd_sketch
from glossalith.llm.components import connected_components
from glossalith.llm.common import Workspace
from glossalith.llm.exact_dedup import exact_dedup
from glossalith.llm.odd_sketch import near_dedup, near_dedup_keep, shingle_set

from ..compare import connect, same


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    """component by row number, from all pairs"""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return [(min(groups[find(i)], key=lambda x: (x is not None, x)), len(sets[i])) for i in range(len(rows))]


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "x" * 50_000), (None, "lone null id text here now"), (9, "é É"), (10, "É É")]


def near_rows(result):
    return sorted(((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in result.collect()), key=repr)


def test_near_dedup_equals_all_pairs_on_documents(docs, spark):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = brute_components(rows)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup(docs).collect()}
    assert got == {i: e for (i, _), e in zip(rows, expected, strict=True)}


def test_near_dedup_edge_cases(documents):
    rows = [(i, t) for i, t in EDGE]
    expected = sorted(((i, c, n, i == c) for (i, _), (c, n) in zip(rows, brute_components(rows), strict=True)), key=repr)
    assert near_rows(near_dedup(documents(rows))) == expected
    flags = near_dedup(documents(rows)).filter("component_id = 7")
    assert flags.count() == 0 or flags.filter("representative").count() == 1


def test_chain_of_near_copies_is_one_component(documents):
    """Neighbours are linked, the ends share nothing: links between copies count, not only those to one origin."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[i * 10 : i * 10 + 150])) for i in range(20)]
    assert {c for _, c, *_ in near_rows(near_dedup(documents(rows)))} == {c for c, _ in brute_components(rows)}


def test_copies_linked_only_through_their_origin(documents):
    origin = [f"w{i}" for i in range(300)]
    copies = []
    for k in range(25):
        w = list(origin)
        for j in range(4):
            w[(k * 11 + j * 71) % 300] = f"k{k}_{j}"
        copies.append((k + 1, " ".join(w)))
    rows = [*copies, (99, " ".join(origin))]
    expected = sorted(((i, c, n, i == c) for (i, _), (c, n) in zip(rows, brute_components(rows), strict=True)), key=repr)
    assert near_rows(near_dedup(documents(rows))) == expected


@pytest.mark.parametrize("rounds", [0, 4])
def test_loose_copies_equal_all_pairs(documents, monkeypatch, rounds):
    """Groups of copies with none to six edits, also without any rounds of offers: the bounds lose no link."""
    monkeypatch.setattr(odd_sketch, "OFFER_ROUNDS", rounds)
    random = np.random.Generator(np.random.PCG64(rounds))
    rows = []
    for g in range(4):
        origin = [f"g{g}w{i}" for i in range(int(random.integers(60, 150)))]
        edited = list(origin)
        for k in range(40):
            w = list(origin if k % 3 else edited)
            for _ in range(random.integers(0, 7)):
                w[random.integers(0, len(w))] = f"e{random.integers(0, 30)}"
            edited = w
            rows.append((len(rows), " ".join(w)))
    expected = sorted(((i, c, n, i == c) for (i, _), (c, n) in zip(rows, brute_components(rows), strict=True)), key=repr)
    assert near_rows(near_dedup(documents(rows))) == expected


def test_threshold_is_inclusive(documents):
    """17 of 20 shingles: exactly 85 percent."""
    a = [f"a{i}" for i in range(22)]  # 18 shingles
    b = a[:21] + ["z0", "z1"]  # shares 17, has 19 itself: 17 / 20
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    assert len(shingles(rows[0][1]) & shingles(rows[1][1])) == 17
    assert len(shingles(rows[0][1]) | shingles(rows[1][1])) == 20
    assert [c for _, c, *_ in near_rows(near_dedup(documents(rows)))] == [1, 1]


def test_near_dedup_of_an_empty_table(documents):
    empty = documents([(1, "x")]).limit(0)
    assert near_dedup(empty).collect() == [] and near_dedup_keep(empty).collect() == []


def test_near_dedup_keep_has_the_input_columns(documents):
    df = documents([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)])
    kept = near_dedup_keep(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_near_dedup_keep_with_null_and_repeated_ids(documents):
    """Rows are told apart by their place: one of each group stays, whatever their ids."""
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "a b c d e f g"), (None, "o p q r s t u"), (None, "v w x y z a b"), (None, None), (None, ""), (2, "H i j k l m n"), (3, "x " * 60_000), (3, "x " * 59_000)]
    kept = near_dedup_keep(documents(rows).withColumn("place", F.lit("mine"))).collect()
    assert sorted(((r.doc_id, (r.text or "").lower()[:13]) for r in kept), key=repr) == sorted([(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "o p q r s t u"), (None, "v w x y z a b"), (None, ""), (None, ""), (3, "x x x x x x x")], key=repr)
    assert all(r.place == "mine" for r in kept)


def test_templates_without_links_are_not_verified_in_pairs(documents, spark, monkeypatch):
    """Texts of one template share buckets but no link: what goes to the full sets stays in proportion to the texts."""
    random = np.random.Generator(np.random.PCG64(4))
    counts = {}
    for n in (150, 600):
        options = [[f"s{k}o{o}" for o in range(4)] for k in range(40)]
        frame = [[f"c{k}w{j}" for j in range(13)] for k in range(40)]
        rows = [(i, " ".join(" ".join([*frame[k], options[k][random.integers(0, 4)]]) for k in range(40))) for i in range(n)]
        verified = []
        real = odd_sketch._verified
        monkeypatch.setattr(odd_sketch, "_verified", lambda pairs, *rest: (verified.append(pairs.count()), real(pairs, *rest))[1])
        got = near_rows(near_dedup(documents(rows)))
        monkeypatch.setattr(odd_sketch, "_verified", real)
        assert got == sorted(((i, c, m, i == c) for (i, _), (c, m) in zip(rows, brute_components(rows), strict=True)), key=repr)
        counts[n] = sum(verified)
    assert counts[600] < 10 * 600 and counts[600] < 6 * counts[150]


def test_chunks_of_a_bucket_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(odd_sketch, "CHUNK", 5)
    monkeypatch.setattr(odd_sketch, "OFFER_ROUNDS", 1)
    random = np.random.Generator(np.random.PCG64(9))
    origin = [f"w{i}" for i in range(90)]
    rows = []
    for k in range(60):
        w = list(origin)
        for _ in range(random.integers(0, 6)):
            w[random.integers(0, 90)] = f"e{random.integers(0, 30)}"
        rows.append((k, " ".join(w)))
    assert near_rows(near_dedup(documents(rows))) == sorted(((i, c, n, i == c) for (i, _), (c, n) in zip(rows, brute_components(rows), strict=True)), key=repr)


@pytest.mark.parametrize("size", [3, 60, 300, 1015, 1030, 1200, 5000, 20_000])
def test_wide_sketches_never_part_linked_sets(spark, size):
    """Pairs of texts whose sets are just linked stay, for sizes on both sides of a level's limit; far ones go."""
    random = np.random.Generator(np.random.PCG64(size))
    lost = int(size * 0.15 / 1.85) - 1
    pairs = []
    for k in range(12):
        w = [f"{k}w{i}" for i in range(size + 4)]
        cut = int(random.integers(0, max(1, lost)))
        near = w[cut:] + [f"{k}n{i}" for i in range(max(0, lost - cut))]
        far = w[: size // 2] + [f"{k}f{i}" for i in range(size // 2)]
        pairs += [(" ".join(w), " ".join(near), True), (" ".join(w), " ".join(far), False)]
    texts = spark.createDataFrame([(2 * i + j, bytearray(p[j].encode())) for i, p in enumerate(pairs) for j in (0, 1)], "node bigint, text binary")
    rows = odd_sketch.wide_sketches(texts, 5, 85)
    joined = rows.alias("l").join(rows.alias("r"), F.expr("l.node + 1 = r.node and l.node % 2 = 0 and l.level = r.level")).select(F.expr("l.node").alias("node"), odd_sketch.may_be_linked("l", "r", 85).alias("may"))
    may = {r.node // 2: r.may for r in joined.groupBy("node").agg(F.max("may").alias("may")).collect()}
    for i, (a, b, close) in enumerate(pairs):
        x, y = shingles(a), shingles(b)
        if 100 * len(x & y) >= 85 * len(x | y):
            assert may[i]
        if not close and size >= 60:
            assert not may.get(i, False)


@pytest.mark.parametrize("similarity", [0.7, 0.85, 0.95])
def test_odd_sketches_estimate_high_similarities(similarity):
    random = np.random.Generator(np.random.PCG64(1))
    a, b = odd_sketch._multipliers()
    base = np.unique(random.integers(0, 1 << 63, 1000, np.uint64))
    shared = int(len(base) * 2 * similarity / (1 + similarity))
    estimates = []
    for _ in range(40):
        other = np.concatenate([random.permutation(base)[:shared], random.integers(0, 1 << 63, len(base) - shared, np.uint64)])
        x, y = (odd_sketch.odd_sketch(odd_sketch.minhash(s, a, b)) for s in (base, other))
        differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        estimates.append(1 + odd_sketch.BITS / (4 * odd_sketch.SAMPLES) * np.log(1 - 2 * differ / odd_sketch.BITS))
    assert abs(np.mean(estimates) - similarity) < 0.03


def test_shingle_hashes_are_as_many_as_shingles(docs):
    for r in docs.select("text").limit(50).collect():
        assert len(shingle_set((r.text or "").encode())) == len(shingles(r.text))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a bigint, b bigint")
    got = connected_components(edges, Workspace(spark, "test"))
    assert {(r.comp, r["count"]) for r in got.groupBy("comp").count().collect()} == {(0, 201), (1000, 2)}


def test_exact_dedup_equals_its_sql(spark, sf_dir):
    from glossalith.llm.queries import ORACLES, op5_exact_dedup

    same(op5_exact_dedup(spark, sf_dir).toPandas(), connect(sf_dir).sql(ORACLES["op5_exact_dedup"]).df())


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_edge_cases(documents, keep):
    df = documents(EDGE).repartition(5)
    got = exact_dedup(df, keep=keep).collect()
    assert len(got) == len(EDGE)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t in EDGE:
        groups[digest(t)].append(i)
    order = (lambda i: (i is None, i)) if keep == "min" else (lambda i: (i is not None, i))
    for r in got:
        ids = groups[r.text_sha256]
        best = (min if keep == "min" else max)(ids, key=order)
        assert (r.keep_id, r.group_size) == (best, len(ids))
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(groups))


def test_exact_dedup_merges_many_runs(spark):
    df = spark.range(0, 3000, 1, 50).selectExpr("id as doc_id", "concat('t', id % 7) as text")
    got = exact_dedup(df, fan_in=3)
    assert {(r.keep_id, r.group_size) for r in got.collect()} == {(k, len(range(k, 3000, 7))) for k in range(7)}
    assert got.filter("kept").count() == 7


def test_exact_dedup_of_an_empty_table_and_a_normalised_text(documents):
    from pyspark.sql import functions as F

    assert exact_dedup(documents([(1, "x")]).limit(0)).collect() == []
    assert exact_dedup(documents([(1, "A b"), (2, "a B")]), normalise=F.lower).filter("kept").count() == 1
