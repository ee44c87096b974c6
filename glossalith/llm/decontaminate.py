"""Benchmark decontamination: a BM25 index of the test items, searched by block-max WAND with every passage."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, Workspace, rename_free, utf8

K1, B = 1.2, 0.75
#: Marks at the edge of a word that do not count.
EDGES = b".,;:!?\"'()[]{}<>|*#$%&_-"
#: Words of a shingle; a shorter part is one shingle of its own length.
N = 5
_SENTENCE_END = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+")


def normal_words(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case and without edge marks; words of marks alone are left out."""
    return [x for w in text.lower().split() if (x := w.strip(EDGES))]


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what stands before it the question; a single sentence is both."""
    parts = [x for x in _SENTENCE_END.split(text.strip(" \t\n\v\f\r")) if x]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def grams(words: list, n: int) -> set[tuple]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Part:
    """The distinct shingles of an item or of a part of it, of `width` words each. A part without words is always held."""

    def __init__(self, words: list[bytes]) -> None:
        self.width = min(N, len(words))
        self.shingles = grams(words, self.width) if words else set()

    def shared(self, have: Callable[[int], set]) -> int:
        return len(self.shingles & have(self.width)) if self.shingles else 0

    def overlap(self, have: Callable[[int], set]) -> float:
        return self.shared(have) / len(self.shingles) if self.shingles else 1.0


def item_weights(words: list[bytes], idf: dict[bytes, float], mean_length: float, min_overlap: float) -> tuple[dict[bytes, float], float]:
    """({term: share of the score that the item reaches on itself}, the least score of a passage that can be accepted).

    A passage with min_overlap of the item's s distinct shingles misses l = s - min_overlap * s of them at most. A word
    that it lacks costs every shingle around the word, one at least and none twice unless shingles repeat, so it lacks l
    words at most (four more where they do), and scores no less than all terms but the l heaviest.
    """
    tf = Counter(words)
    weight = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean_length)) for w, n in tf.items()}
    whole = sum(weight.values())
    impacts = {w: x / whole for w, x in weight.items()}
    part = Part(words)
    lost = len(part.shingles) - math.ceil(min_overlap * len(part.shingles) - 1e-9)
    if lost and len(part.shingles) < len(words) - part.width + 1:
        lost += N - 1
    heaviest = sorted(impacts.values(), reverse=True)
    return impacts, max(sum(heaviest[lost:]), heaviest[-1])


def essential_terms(impacts: dict[bytes, float], least: float) -> list[bytes]:
    """The heaviest terms, as many as leave less than `least` to the others: a passage without any of them scores less."""
    out, rest = [], sum(impacts.values())
    for w, x in sorted(impacts.items(), key=lambda p: (-p[1], p[0])):
        if rest < least - 1e-9:
            break
        out.append(w)
        rest -= x
    return out


class Index:
    """Impact-ordered inverted index of one block of test items.

    An item's score is its BM25 score divided by the least score of a passage that can be accepted, so the threshold is 1
    for items of any length and no acceptable passage is below it. Postings are sorted by item and cut in blocks that
    carry their largest impact.
    """

    def __init__(self, items: list[tuple[int, str]], idf: dict[bytes, float], mean_length: float, min_overlap: float = 0.8, min_part: float = 0.5, block: int = 32) -> None:
        self.ids, self.parts, self.least, postings, essential = [], [], [], {}, set()
        self.longest, self.block, self.min_overlap, self.min_part = 1, block, min_overlap, min_part
        for item_id, text in items:
            words = normal_words(text.encode())
            if not words:
                continue
            impacts, least = item_weights(words, idf, mean_length, min_overlap)
            for w, x in impacts.items():
                postings.setdefault(w, []).append((len(self.ids), x / least))
            essential.update(essential_terms(impacts, least))
            self.ids.append(item_id)
            self.least.append(least)
            self.parts.append([Part(words), *(Part(normal_words(p.encode())) for p in question_and_answer(text))])
            self.longest = max(self.longest, len(words))
        # essential terms come first, so one comparison tells them
        self.terms = {w: i for i, w in enumerate(sorted(postings, key=lambda w: w not in essential))}
        self.essential = len(essential)
        self.postings = [postings[w] for w in self.terms]
        self.block_max = [[(p[min(j + block, len(p)) - 1][0], max(x for _, x in p[j : j + block])) for j in range(0, len(p), block)] for p in self.postings]
        self.upper = [max(x for _, x in p) for p in self.postings]

    def bounds(self, columns: int = 64):
        """Matrix [term, group]: the term's largest impact in each of `columns` groups of neighbouring items; the last
        row, of zeros, is for words that no item has. A passage's row sum over its words bounds every item of a group."""
        import numpy as np

        size = max(1, -(-len(self.ids) // columns))
        out = np.zeros((len(self.postings) + 1, -(-len(self.ids) // size) or 1), np.float32)
        for t, postings in enumerate(self.postings):
            for k, x in postings:
                out[t, k // size] = max(out[t, k // size], x)
        return out

    def search(self, terms: set[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score on the passage's terms reaches the threshold."""
        found = []
        lists = [[t, 0, 0] for t in terms]  # term, position, block
        item = lambda x: self.postings[x[0]][x[1]][0]
        while lists:
            lists.sort(key=item)
            bound, pivot = 0.0, None
            for n, x in enumerate(lists):
                bound += self.upper[x[0]]
                if bound >= threshold:
                    pivot = n
                    break
            if pivot is None:
                break
            target = item(lists[pivot])
            while pivot + 1 < len(lists) and item(lists[pivot + 1]) == target:
                pivot += 1
            blocks, ends = 0.0, []
            for x in lists[: pivot + 1]:
                marks = self.block_max[x[0]]
                while x[2] < len(marks) and marks[x[2]][0] < target:
                    x[2] += 1
                if x[2] < len(marks):
                    blocks += marks[x[2]][1]
                    ends.append(marks[x[2]][0])
            if blocks < threshold:
                # no item up to the nearest block end can reach the threshold
                until = min(ends, default=target) + 1
                if pivot + 1 < len(lists):
                    until = min(until, item(lists[pivot + 1]))
                target = max(until, target + 1)
                lists = self._advance(lists, pivot, target)
            elif item(lists[0]) == target:
                score = sum(self.postings[x[0]][x[1]][1] for x in lists[: pivot + 1])
                if score >= threshold:
                    found.append((target, score))
                lists = self._advance(lists, pivot, target + 1)
            else:
                lists = self._advance(lists, pivot, target)
        return found

    def _advance(self, lists: list, pivot: int, target: int) -> list:
        for x in lists[: pivot + 1]:
            p, marks = self.postings[x[0]], self.block_max[x[0]]
            while x[2] < len(marks) and marks[x[2]][0] < target:
                x[2] += 1
                x[1] = max(x[1], x[2] * self.block)
            while x[1] < len(p) and p[x[1]][0] < target:
                x[1] += 1
        return [x for x in lists if x[1] < len(self.postings[x[0]])]

    def matcher(self) -> Callable[[bytes], dict[int, tuple]]:
        """text -> {item: (shared shingles, score, question overlap, answer overlap)} of the items that the text holds, each
        from its best passage."""
        import numpy as np

        half, none, bounds = self.longest, len(self.upper), self.bounds()

        def code(word: bytes) -> int:
            word = word.strip(EDGES)
            return self.terms.get(word, none) if word else -1

        term = WordCache(code)

        def match(text: bytes) -> dict[int, tuple]:
            raw = text.lower().split()
            codes = np.fromiter(map(term.__getitem__, raw), np.int32, len(raw))
            if not (real := codes >= 0).all():  # words of marks alone
                raw, codes = [w for w, ok in zip(raw, real.tolist(), strict=True) if ok], codes[real]
            best: dict[int, tuple] = {}
            for start in passages(codes, half, self.essential):
                window = np.unique(codes[start : start + 2 * half])
                if bounds[window].sum(0, dtype=np.float64).max() < 1 - 1e-4:
                    continue
                found = self.search(set(window.tolist()) - {none}, 1 - 1e-9)
                if not found:
                    continue
                words, known = [w.strip(EDGES) for w in raw[start : start + 2 * half]], {}
                have = lambda n: known[n] if n in known else known.setdefault(n, grams(words, n))  # noqa: B023, E731
                for k, score in found:
                    whole, question, answer = self.parts[k]
                    shared = whole.shared(have)
                    if shared >= self.min_overlap * len(whole.shingles) - 1e-9:
                        parts = question.overlap(have), answer.overlap(have)
                        if min(parts) >= self.min_part:
                            best[k] = max(best.get(k, ()), (shared, score * self.least[k], *parts))
            return best

        return match


def passages(codes, half: int, essential: int) -> list[int]:
    """Starts of the passages (2 * half words, every half words) that hold an essential term (codes 0 to essential - 1)."""
    import numpy as np

    at = np.flatnonzero(codes < essential)
    if not len(at):
        return []
    own = at // half * half
    last = max(0, (-(-len(codes) // half) - 2) * half)  # what follows the last start lies within its passage
    starts = np.unique(np.concatenate([own, own - half]))
    return np.unique(starts.clip(0, last)).tolist()


OUT = "doc_id bigint, item_id bigint, bm25 double, item_shingles bigint, shared_shingles bigint, question_overlap double, answer_overlap double"


def contaminated_pairs(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_overlap: float = 0.8, min_part: float = 0.5, index_bytes: int = 32 << 20
) -> DataFrame:
    """One row per (document, test item) whose passages hold the item.

    Every document is cut into passages of twice the longest item, each starting in the middle of the one before, so
    an item copied into a text lies whole in one passage. A passage is searched by block-max WAND when it holds a term
    that is essential to some item and the largest impacts of its words reach the threshold in some group of items. The
    threshold is an item's own: the least BM25 score of a passage that verification can accept. Verification counts
    distinct 5-word shingles in the passage: min_overlap of all of the item's, and min_part each of those of its
    question and its answer. A part with fewer than five words is one shingle of its own length, and held where these
    words follow each other. The best passage of a document counts.

    Up to index_bytes of item text, the index goes to all tasks. More items are cut into blocks of that size, and a
    document goes to the blocks to which one of its words is essential (see _routed): the documents are read once, and
    no index is on the driver. Document frequencies are counted over all items.

    Ids are only carried: null and repeated ones give rows of their own. Null or empty texts and items match nothing;
    repeated items are found each under its own id; repeated documents give equal rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    known = _Items(items, item_id_col, item_text_col, index_bytes)
    if known.blocks > 1:
        return _routed(rows, known, min_overlap, min_part)[1]
    sent = known.broadcast(min_overlap, min_part)

    def matched(batches: Iterator) -> Iterator:
        index = Index(*sent.value)
        match = index.matcher()
        for batch in batches:
            texts = (t.as_buffer().to_pybytes() for t in batch.column(1))
            yield _out([r for i, t in zip(batch.column(0).to_pylist(), texts, strict=True) for r in _rows(i, match(t), index)])

    return rows.mapInArrow(matched, OUT)


def _rows(doc_id: int | None, best: dict[int, tuple], index: Index) -> list[tuple]:
    return [(doc_id, index.ids[k], score, len(index.parts[k][0].shingles), shared, q, a) for k, (shared, score, q, a) in sorted(best.items())]


def _out(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.float64() if c.endswith("double") else pa.int64() for c in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=[c.split()[0] for c in OUT.split(", ")])


class _Items:
    """The test items that have text, the number of their blocks, and the document frequencies of their words."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, index_bytes: int) -> None:
        self.spark = items.sparkSession
        self.source = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text is not null")
        size, self.n = self.source.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
        self.blocks = max(1, math.ceil((size or 0) / index_bytes))

        def counted(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                n, df = 0, Counter()
                for text in batch.column(0).to_pylist():
                    words = normal_words(text)
                    n += len(words)
                    df.update(set(words))
                # the total of words goes under the empty word, which no text has
                yield pa.RecordBatch.from_arrays([pa.array([b"", *df], pa.binary()), pa.array([n, *df.values()], pa.int64())], names=["word", "df"])

        self.counts = self.source.select(utf8("text").alias("text")).mapInArrow(counted, "word binary, df bigint").groupBy("word").agg(F.sum("df").alias("df"))

    def idf(self, df: int) -> float:
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5))

    def mean(self, words: int) -> float:
        return max(1.0, words / max(1, self.n))

    def broadcast(self, min_overlap: float, min_part: float):
        rows = [(r[0], r[1]) for r in self.source.orderBy("item_id", "text").collect()]  # at most index_bytes
        df = {bytes(r[0]): r[1] for r in self.counts.collect()}  # of their words
        mean = self.mean(df.pop(b"", 0))
        return self.spark.sparkContext.broadcast((rows, {w: self.idf(n) for w, n in df.items()}, mean, min_overlap, min_part))


def _routed(docs: DataFrame, items: _Items, min_overlap: float, min_part: float, group_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(docs with a column place__, pairs with a column place__) by way of blocks of items.

    An item goes with its words' frequencies to its block. Documents meet blocks in an equi-join of their words with the
    blocks' essential terms, and are dealt by (block, salt) to groups of about group_bytes of text, each of which meets
    its block's items once. What no group can hold in memory is a single text beyond that size.
    """
    ws = Workspace(items.spark, "decontaminate")
    place = rename_free(docs.columns, "place__")
    own = ws.save(items.source.select("item_id", "text", F.monotonically_increasing_id().alias("item")).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(items.blocks)).cast("int")), "items")
    numbered = ws.save(docs.withColumn(place, F.monotonically_increasing_id()), "docs")
    counts = ws.save(items.counts, "counts")
    mean = items.mean(counts.filter("word = X''").select("df").first()[0])

    def item_words(batches: Iterator) -> Iterator:
        return _words_of(batches, ["item", "word"])

    words = own.select("item", utf8("text").alias("text")).mapInArrow(item_words, "item bigint, word binary").join(counts, "word")
    weighed = ws.save(own.join(words.groupBy("item").agg(F.collect_list(F.struct("word", "df")).alias("words")), "item"), "weighed")  # of one item's words

    def essential(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for block, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                impacts, least = item_weights(normal_words(text.encode()), {x["word"]: items_idf(x["df"]) for x in found}, mean, min_overlap)
                out += [(w, block) for w in essential_terms(impacts, least)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([b for _, b in out], pa.int32())], names=["word", "block"])

    n_items = items.n
    items_idf = lambda df: math.log(1 + (n_items - df + 0.5) / (df + 0.5))
    keys = weighed.select("block", "text", "words").mapInArrow(essential, "word binary, block int").distinct()

    def doc_words(batches: Iterator) -> Iterator:
        return _words_of(batches, ["place", "word"])

    held = numbered.select(F.col(place).alias("place"), "text").mapInArrow(doc_words, "place bigint, word binary")
    met = ws.save(held.join(keys, "word").select("place", "block").distinct(), "met")
    sizes = met.join(numbered.select(F.col(place).alias("place"), F.octet_length("text").alias("size")), "place").groupBy("block").agg(F.ceil(F.sum("size") / group_bytes).cast("int").alias("salts"))
    salts = sizes.select("block", F.greatest("salts", F.lit(1)).alias("salts"))
    left = numbered.select(F.col(place).alias("place"), "doc_id", "text").join(met, "place").join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("place"), F.col("salts")).cast("int"))
    right = weighed.join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("block", "salt", "item", "item_id", F.col("text"), "words")

    def matched(texts, known):
        import pyarrow as pa

        entries = sorted(zip(*(known.column(c).to_pylist() for c in ("item_id", "text", "words")), strict=True), key=lambda e: e[:2])
        index = Index([e[:2] for e in entries], {x["word"]: items_idf(x["df"]) for e in entries for x in e[2]}, mean, min_overlap, min_part)
        match, out, places = index.matcher(), [], []
        for at, doc_id, text in zip(texts.column("place").to_pylist(), texts.column("doc_id").to_pylist(), texts.column("text"), strict=True):
            rows = _rows(doc_id, match(text.as_buffer().to_pybytes()), index)
            out, places = out + rows, places + [at] * len(rows)
        return pa.Table.from_batches([_out(out)]).append_column(place, pa.array(places, pa.int64()))

    pairs = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(matched, f"{OUT}, {place} bigint")
    return numbered, ws.save(pairs, "pairs")


def _words_of(batches: Iterator, names: list[str]) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = list(set(normal_words(text.as_buffer().to_pybytes())))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), key, np.int64)), pa.array(words, pa.binary())], names=names)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_overlap: float = 0.8, min_part: float = 0.5, index_bytes: int = 32 << 20) -> DataFrame:
    """docs without the rows whose text holds a test item (see contaminated_pairs).

    Each row is judged by its own text: ids are not read, so null and repeated ones lose no other row and save none.
    Null and empty texts stay, repeated rows stay or go together, an empty table stays empty, all columns pass through.
    """
    known = _Items(items, item_id_col, item_text_col, index_bytes)
    if known.blocks > 1:
        text, place = rename_free(docs.columns, "text__"), rename_free([*docs.columns, "doc_id", "text"], "place__")
        ws = Workspace(docs.sparkSession, "decontaminate-rows")
        rows = ws.save(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
        leaked = _routed(rows.select(F.col(place).alias("doc_id"), utf8(text_col).alias("text")), known, min_overlap, min_part)[1]
        return rows.join(leaked.select(F.col("doc_id").alias(text)).distinct(), F.col(place) == F.col(text), "left_anti").drop(place)
    sent = known.broadcast(min_overlap, min_part)

    def holds(batches: Iterator) -> Iterator:
        import pyarrow as pa

        match = Index(*sent.value).matcher()
        for batch in batches:
            yield pa.array([bool(match(t.as_buffer().to_pybytes())) for t in batch], pa.bool_())

    # only the texts go to Python; a row's other columns wait in the JVM
    from collections.abc import Iterator as Batches

    import pyarrow as pa

    holds.__annotations__ = {"batches": Batches[pa.Array], "return": Batches[pa.Array]}
    return docs.filter(~F.arrow_udf(holds, "boolean")(utf8(text_col)))
