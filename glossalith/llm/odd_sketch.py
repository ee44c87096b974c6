"""Near-duplicates: MinHash bands, odd sketches of the samples, exact confirmation on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, Workspace, ascii_words, rename_free, utf8
from .components import connected_components

#: Rows of a band and number of bands: a pair of similarity 0.85 shares no band with probability 4e-7.
ROWS, BANDS = 4, 20
SAMPLES = ROWS * BANDS
#: Most rounds in which every component makes one offer, before the pairs still open are all confirmed.
OFFER_ROUNDS = 4
#: Bits of an odd sketch; about six times the samples, so parities rarely cancel.
BITS = 512
#: Bits of the odd sketch of a whole set, and the most shingles that one takes; of larger sets a half, a quarter, ... by hash.
WIDE, FULL = 1024, 1024
#: Rows of a bucket that are compared in one task.
CHUNK = 1024

_WORDS: WordCache | None = None


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingle_set(text: bytes, words_per_shingle: int = 5):
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words make one shingle; none, an empty set."""
    import numpy as np

    global _WORDS
    _WORDS = WordCache(_word_hash, 150_000) if _WORDS is None else _WORDS
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(words_per_shingle, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _multipliers():
    import numpy as np

    random = np.random.Generator(np.random.PCG64(20240229))
    return random.integers(1, 1 << 32, SAMPLES, np.uint32) | np.uint32(1), random.integers(0, 1 << 32, SAMPLES, np.uint32)


def minhash(shingles, a, b):
    """SAMPLES minima of x -> (x xor x>>15-mixed) a + b over the set, in blocks so that long texts need little memory."""
    import numpy as np

    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 8192):
        y = x[None, i : i + 8192] * a[:, None]
        y ^= b[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x85EBCA6B)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def odd_sketch(samples):
    """Parity bitmap of the (place, value) samples as BITS/64 signed longs."""
    import numpy as np

    place = np.arange(SAMPLES, dtype=np.uint64)
    z = (samples.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.bincount((z >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def band_keys(samples):
    """One 64-bit key per band; the band's number is mixed in, so keys of different bands never meet."""
    import numpy as np

    s = samples.reshape(BANDS, ROWS).astype(np.uint64)
    h = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(ROWS):
        h = (h ^ s[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


SIGNED = "id bigint, run int, place bigint, klass binary, n_shingles bigint, bands array<bigint>, odd array<bigint>"
SIGNED_NAMES = [c.split()[0] for c in SIGNED.split(", ")]


def _sign(words_per_shingle: int):
    def signed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        a, b = _multipliers()
        for batch in filter(len, batches):
            klass, n, bands, odd = [], [], [], []
            for text in batch.column(3):
                s = shingle_set(text.as_buffer().to_pybytes(), words_per_shingle)
                klass.append(xxhash.xxh3_128_digest(s.tobytes()))
                n.append(len(s))
                m = minhash(s, a, b)
                bands.append(band_keys(m))
                odd.append(odd_sketch(m))
            flat = lambda parts, k: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(klass, pa.binary()), pa.array(n, pa.int64()), flat(bands, BANDS), flat(odd, BITS // 64)], names=SIGNED_NAMES)

    return signed


def odd_similarity(x: Column, y: Column) -> Column:
    """Similarity that two odd sketches suggest: 1 + BITS/(4 SAMPLES) ln(1 - 2 popcount(x xor y) / BITS), 0 below reach."""
    differ = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(BITS // 64)), F.lit(0))
    part = 1 - 2 * differ / F.lit(BITS)
    return F.when(part <= 0, F.lit(0.0)).otherwise(1 + F.lit(BITS / (4 * SAMPLES)) * F.log(F.greatest(part, F.lit(1e-9))))


def _intersections(pairs: DataFrame, texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """(a, b, n_a, n_b, both): sizes of the pairs' full sets and of their intersection. b is the side with few values: its
    set is built once for all rows that follow each other, as the join leaves them sorted by b."""

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, other = None, None
        for batch in batches:
            out = []
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if b != last:
                    last, other = b, shingle_set(batch.column(3)[k].as_buffer().to_pybytes(), words_per_shingle)
                own = shingle_set(batch.column(2)[k].as_buffer().to_pybytes(), words_per_shingle)
                out.append((a, b, len(own), len(other), len(np.intersect1d(own, other, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(5)], names=["a", "b", "n_a", "n_b", "both"])

    rows = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(counted, "a bigint, b bigint, n_a bigint, n_b bigint, both bigint")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, words_per_shingle: int) -> DataFrame:
    """The pairs (a, b) with 100 |intersection| >= percent |union|."""
    counted = _intersections(pairs, texts, words_per_shingle)
    return counted.filter(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent).select("a", "b")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words_per_shingle: int = 5) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, representative.

    1. One Arrow pass makes each text's class (digest of its shingle set), band keys and odd sketch.
    2. Rows of one class are one node, so copies never meet in pairs; nodes that share a band key make a bucket.
    3. In rounds, each component makes one offer: of its members' neighbours in a bucket (next to each other in the order
       of the following bands) and of the buckets' heaviest members, the one that the odd sketches find most similar. The
       offers are confirmed on the full sets and join components, so a round has at most as many pairs as components.
    4. Members of a bucket that are still in different components are compared by odd sketches of their whole sets, each
       member outside the bucket's largest component with the other components' members. No more bits differ than
       shingles do, so a pair with more differing bits than linked sets have differing shingles is not linked: nothing
       is lost by it, and what is left, which is little beyond the linked pairs themselves, is confirmed on full sets.
       (Sets of over FULL shingles are sampled by hash: five standard deviations are allowed for that.)

    A bucket's rows are dealt to tasks in chunks of about CHUNK, so no key is one task's.
    Linked means 100 |intersection| >= percent |union|, on 64-bit hashes of shingles: two of the n shingles of a pair agree
    by chance with a probability of n * n / 2**65. component_id is the smallest id reachable; kept is
    id = component_id; representative is true for exactly one row of a component, also when ids repeat.
    Null and empty texts (or white space alone) have no shingles and are linked with nothing. A null id counts as
    smallest. Repeated rows are of one class; very long texts are read whole. An empty table gives an empty result. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    ws = Workspace(docs.sparkSession, "odd-sketch")
    found = _components(ws.save(rows, "rows"), ws, percent, words_per_shingle)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept", "representative")


def _components(source: DataFrame, ws: Workspace, percent: int, words_per_shingle: int) -> DataFrame:
    """source: a written table (id, text, place) -> (id, place, n_shingles, component_id, kept, representative). Texts are
    read from it until those with candidates are written; a table "rows" of ws is dropped then."""
    spark = source.sparkSession
    signed = ws.save(source.select("id", F.spark_partition_id().alias("run"), "place", "text").mapInArrow(_sign(words_per_shingle), SIGNED), "signed")

    # classes, by way of the rows' runs: a class with a third of all rows has a row per run here
    rank = F.struct("id", "place")
    local = signed.groupBy("klass", "run").agg(F.min(rank).alias("best"), F.first("n_shingles").alias("n_shingles"))
    classes = ws.save(local.groupBy("klass").agg(F.min("best").alias("best"), F.first("n_shingles").alias("n_shingles")), "classes")
    # sides that grow with the rows are shuffled at every size, narrow ones first
    nodes = classes.filter("n_shingles > 0").select(F.col("best.place").alias("place"), "klass")
    sketches = ws.save(signed.join(nodes.hint("merge"), ["place", "klass"], "left_semi").select(F.col("place").alias("node"), "n_shingles", "bands", "odd"), "sketches")

    keyed = sketches.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = ws.save(keyed.join(shared.hint("merge"), "key").select("key", "node", "n", F.col("band").cast("byte").alias("band")), "buckets")
    # a common origin of near copies shares more buckets, and larger ones, than its copies do among themselves
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    # the bands after a row's own: members of a bucket that agree in these too stand next to each other
    after = F.slice(F.concat("bands", "bands"), F.col("band") + 2, 3).alias("after")
    members = buckets.join(weight.join(sketches, "node"), "node").select("key", "node", "n", "weight", "n_shingles", "odd", after)
    members = ws.save(members, "members")
    ws.drop("buckets")
    # 0.2 below the limit: five standard deviations of the sketches' estimate there
    floor = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / SAMPLES)

    comps = ws.save(members.select("node").distinct().withColumn("comp", F.col("node")), "comps-0")
    texts = ws.save(source.select(F.col("place").alias("node"), "text").join(comps, "node", "left_semi"), "texts")
    ws.drop("rows")
    tried = spark.createDataFrame([], "a bigint, b bigint")
    for k in range(1, OFFER_ROUNDS + 1):
        asked = ws.save(_offers(members.join(comps, "node"), tried, percent, floor), f"asked-{k}")
        found = ws.save(_verified(asked, texts, percent, words_per_shingle), f"found-{k}")
        if not found.limit(1).count():
            break
        comps, tried = _merged(comps, found, ws, k), tried.unionByName(asked)

    across = ws.save(_across(members.join(comps, "node"), texts, ws, percent, words_per_shingle), "across")
    known = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = ws.save(_verified(across.join(known, ["a", "b"], "left_anti"), texts, percent, words_per_shingle), "rest")
    if rest.limit(1).count():
        comps = _merged(comps, rest, ws, 0)
    ws.drop("texts", "open", "wide", "members")

    grouped = classes.withColumn("node", F.col("best.place")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tops = grouped.groupBy("comp").agg(F.min("best").alias("top"))
    placed_classes = grouped.join(tops, "comp").select("klass", "n_shingles", "best", "top")
    by_run = local.select("klass", "run").join(placed_classes.filter("n_shingles > 0"), "klass").drop("n_shingles", "best")
    rows = signed.select("id", "run", "place", "klass", "n_shingles").join(by_run, ["klass", "run"], "left")
    alone = F.col("n_shingles") == 0
    return rows.select(
        "id",
        "place",
        "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("top.id")).alias("component_id"),
        (alone | F.col("id").eqNullSafe(F.col("top.id"))).alias("kept"),
        (alone | (F.col("place") == F.col("top.place"))).alias("representative"),
    )


def _salts(n: str) -> Column:
    return (1 + F.floor(F.col(n) / CHUNK)).cast("int")


def _salt(salts: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), salts).cast("int")


def _every(salts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), salts - 1))


def _offers(placed: DataFrame, tried: DataFrame, percent: int, floor: float) -> DataFrame:
    """(a, b): for each component the most promising pair of one of its members with one of another component in the
    same bucket, not tried before. placed: key, n (rows of the bucket), node, after, weight, n_shingles, odd, comp."""
    own = ("node", "comp", "n_shingles", "odd")
    parts = placed.groupBy("key", "comp").agg(F.first("n").alias("all"), F.count(F.lit(1)).alias("n"), F.max(F.struct("weight", *own)).alias("top"))
    centres = parts.groupBy("key").agg(F.max(F.struct("n", "top")).alias("c"), F.count(F.lit(1)).alias("comps"), F.first("all").alias("all")).filter("comps > 1")
    centres = centres.select("key", F.struct(*(F.col(f"c.top.{x}").alias(x) for x in own)).alias("centre"), _every(_salts("all")).alias("salt"))
    rows = placed.withColumn("salt", _salt(_salts("n"), 1)).join(centres, ["key", "salt"])
    before = F.lag(F.struct(*own)).over(Window.partitionBy("key", "salt").orderBy("after", "node"))
    sides = rows.withColumn("before", before).select(F.struct(*own).alias("x"), F.explode(F.array("before", "centre")).alias("y")).filter("y is not null and x.comp <> y.comp")
    similar = sides.withColumn("s", odd_similarity(F.col("x.odd"), F.col("y.odd"))).filter((F.col("s") >= floor) & (F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * percent))
    pair = F.struct(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    fresh = similar.select("s", F.col("x.comp").alias("p"), F.col("y.comp").alias("q"), pair.alias("pair")).select("s", "p", "q", "pair.a", "pair.b").distinct().join(tried, ["a", "b"], "left_anti")
    both = fresh.select(F.explode(F.array("p", "q")).alias("comp"), F.struct("s", "a", "b").alias("o"))
    return both.groupBy("comp").agg(F.max("o").alias("o")).select("o.a", "o.b").distinct()


def wide_sketches(texts: DataFrame, words_per_shingle: int, percent: int) -> DataFrame:
    """(node, n_shingles, level, bits): odd sketches of whole sets. At level l those shingles are folded whose hash ends
    in l zero bits. A set has a row for the first level that leaves FULL of its shingles at most, and one for the next
    level where a linked set may be that much larger, so linked sets have a level in common."""

    def folded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in filter(len, batches):
            out = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_buffer().to_pybytes(), words_per_shingle)
                levels = sorted({max(0, math.ceil(math.log2(max(1, n) / FULL))) for n in (len(s), len(s) * 100 / percent)})
                for level in levels:
                    at = (s[s & np.uint64((1 << level) - 1) == 0] >> np.uint64(40)).astype(np.int64) % WIDE
                    out.append((node, len(s), level, np.packbits((np.bincount(at, minlength=WIDE) & 1).astype(np.uint8)).view(np.int64)))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * (WIDE // 64)), pa.array(np.concatenate([r[3] for r in out])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()), bits], names=["node", "n_shingles", "level", "bits"])

    return texts.select("node", "text").mapInArrow(folded, "node bigint, n_shingles bigint, level int, bits array<bigint>")


def may_be_linked(x: str, y: str, percent: int) -> Column:
    """False only for pairs of rows x, y (n_shingles, level, bits) of one level that are not linked: linked sets of a and
    b shingles differ in at most (a + b) (100 - percent) / (100 + percent), and differing bits are no more than these."""
    a, b = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    differ = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(WIDE // 64)), F.lit(0))
    level = F.col(f"{x}.level")
    most = (a + b) * F.lit((100 - percent) / (100 + percent)) / F.pow(F.lit(2.0), level)
    sizes = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    return sizes & (differ <= most + F.when(level > 0, 5 * F.sqrt(most) + 5).otherwise(1e-6))


def _across(placed: DataFrame, texts: DataFrame, ws: Workspace, percent: int, words_per_shingle: int) -> DataFrame:
    """(a, b): pairs of different components that share a bucket and may be linked, each once."""
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("major"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    split = split.select("key", F.col("major.comp").alias("major"), (F.col("n") - F.col("major.n")).alias("minor"))
    open_rows = ws.save(placed.select("key", "node", "comp").join(split, "key"), "open")
    wide = ws.save(wide_sketches(texts.join(open_rows.select("node").distinct(), "node", "left_semi"), words_per_shingle, percent), "wide")
    rows = open_rows.join(wide, "node").withColumn("salts", _salts("minor"))
    left = rows.filter("comp <> major").withColumn("salt", _salt(F.col("salts"), 2)).alias("l")
    right = rows.withColumn("salt", _every(F.col("salts"))).alias("r")
    apart = (F.col("l.comp") != F.col("r.comp")) & ((F.col("r.comp") == F.col("r.major")) | (F.col("l.node") < F.col("r.node")))
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.level") == F.col("r.level"))
    met = left.join(right, same & apart & may_be_linked("l", "r", percent))
    return met.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def _merged(comps: DataFrame, links: DataFrame, ws: Workspace, k: int) -> DataFrame:
    """comps (node, comp) after links (a, b) between their nodes; only the components that links touch are searched."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").filter("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    grown = connected_components(edges, ws, f"merge-{k}").select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    return ws.save(comps.join(grown, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), f"comps-{k}" if k else "comps-last")


def near_dedup_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words_per_shingle: int = 5) -> DataFrame:
    """The rows of docs that near_dedup calls representative, one of each group, with docs' own columns.

    Rows are written once with a number of their own, by which they are kept, so null and repeated ids make no difference
    but for which row of a group stays (the smallest id, null first). Rows without words all stay.
    """
    place = rename_free(docs.columns, "place")
    ws = Workspace(docs.sparkSession, "near-dedup-rows")
    rows = ws.save(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
    source = rows.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"), F.col(place).alias("place"))
    kept = _components(source, Workspace(docs.sparkSession, "odd-sketch"), percent, words_per_shingle).filter("representative")
    return rows.join(kept.select(F.col("place").alias(place)), place, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
