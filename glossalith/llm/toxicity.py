"""Toxicity: words are restored by Viterbi decoding of character lattices, then scored with evidence learned from labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, Workspace, sigmoid, utf8
from .odd_sketch import shingle_set

# Letters that a mark or digit may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "*": "aeiou",
}
#: Marks that only surround words.
EDGES = ".,;:!?\"'()[]{}<>|*#%&_-~^`=/\\«»„“”…"
SYMBOLS = 28
_CODES = bytes((b - 96 if 97 <= b <= 122 else 0 if b == 32 else 27) for b in range(256))
#: Longer tokens are read in pieces.
LONGEST = 40
COST = {"leet": 0.4, "drop": 0.8, "literal": 4.0, "repeat": 0.8, "gap": 1.5}


def trigram_counts(words: Counter):
    """Counts of character trigrams, words weighted by their counts. Letters beyond a-z count as one symbol per byte."""
    import numpy as np

    if not words:
        return np.zeros(SYMBOLS**3)
    spelt = [w.encode() for w in words]
    codes = np.frombuffer((b"  " + b"  ".join(spelt) + b" ").translate(_CODES), np.uint8).astype(np.int64)
    weight = np.repeat(np.fromiter(words.values(), np.float64, len(words)), [len(w) + 2 for w in spelt])
    code = codes[:-2] * SYMBOLS * SYMBOLS + codes[1:-1] * SYMBOLS + codes[2:]
    return np.bincount(code, weight[: len(code)], SYMBOLS**3)


def character_model(docs: DataFrame, text_col: str = "text"):
    """Log probabilities [a, b, c] of c after a, b, from the words of all documents.

    Each task adds up its documents and hands on the trigrams that occur, at most 28**3 of them.
    """
    import numpy as np

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        total, words = np.zeros(SYMBOLS**3), Counter()
        for batch in batches:
            for text in batch.column(0):
                words.update(text.as_buffer().to_pybytes().decode("utf-8", "replace").lower().split())
                if len(words) > 60_000:
                    total += trigram_counts(words)
                    words.clear()
        total += trigram_counts(words)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    rows = docs.select(utf8(text_col).alias("text")).mapInArrow(counted, "code bigint, n double").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(SYMBOLS**3)
    for code, count in rows:
        n[code] = count
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = n.sum((0, 1)) + 1
    two = n.sum(0) + 2 * (one / one.sum())
    two /= two.sum(1, keepdims=True)
    three = n + 5 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings, with costs, of each stretch of a token. A blank in the token is a gap between spaced letters."""
    steps, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if c == " ":
            steps.append([("", 0.0), (" ", COST["gap"])])
        elif c.isalpha():
            if n >= 3:
                steps.append([(c, COST["repeat"]), (c * 2, COST["repeat"]), (c * n, 0.0 if n == 3 else COST["repeat"] * 2)])
            else:
                steps += [[(c, 0.0)]] * n
        else:
            read = [(x, COST["leet"] + 0.1 * k) for k, x in enumerate(LEET.get(c, ""))]
            for _ in range(min(n, 3)):
                steps.append([*read, ("", COST["drop"])] if not c.isdigit() else [*read, ("0", COST["literal"])])
        i = j
    return steps


def restore(token: str, model) -> str:
    """The likeliest reading of an obfuscated token under the character model (Viterbi over the lattice; the state is
    the last two characters)."""
    best = {(0, 0): (0.0, "")}
    for step in lattice(token):
        new: dict = {}
        for (a, b), (score, text) in best.items():
            for read, cost in step:
                x, y, s = a, b, score - cost
                for c in read:
                    k = _symbol(c)
                    s += model[x][y][k]
                    if k == 0:
                        x = y = 0
                    else:
                        x, y = y, k
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, text + read)
        best = new
    return max((s + model[a][b][0], text) for (a, b), (s, text) in best.items())[1]


_PLAIN = re.compile(r"([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")


_MARKS = re.compile(r"[\W_]+")
#: Marks that stand for no letter.
_SEPARATORS = re.compile(rf"(?:[^\w{re.escape(''.join(c for c in LEET if not c.isdigit()))}]|_)+")
_REPEATED = re.compile(r"(.)\1{3,}", re.DOTALL)
_LETTERS = re.compile(r"[^\W\d_]{3,}")


def _windows(parts: list[str]) -> list[str]:
    """Neighbouring parts with blanks between, as long as LONGEST allows; windows overlap by half."""
    out, i = [], 0
    while i < len(parts):
        j, n = i, -1
        while j < len(parts) and n + 1 + len(parts[j]) <= LONGEST:
            n, j = n + 1 + len(parts[j]), j + 1
        if j - i > 1:
            out.append(" ".join(parts[i:j]))
        if j == len(parts):
            break
        i = max(i + 1, (i + j) // 2)
    return out


def pieces(token: str) -> list[str]:
    """What a token of over LONGEST characters is read as. Repetitions are shortened as far as the lattice tells them
    apart; what is still too long is split at marks, and the parts are also joined in windows, as marks may pad a
    word. Parts that are too long without such marks are cut into windows and runs of letters; of those in which letters
    and digits alternate without three letters in a row (keys, hashes) nothing is read."""
    token = _REPEATED.sub(lambda m: m[1] * (4 if m[1].isalpha() else 3), token)
    if len(token) <= LONGEST or (token.isalpha() and not _PLAIN.search(token)):
        return [token]
    parts = [p for p in _SEPARATORS.split(token) if p]
    if parts != [token]:
        return list(dict.fromkeys([*(q for p in parts for q in pieces(p)), *_windows(parts)]))
    if token.isalnum() and not _LETTERS.search(token):
        return []
    cut = [token[i : i + LONGEST] for i in range(0, max(1, len(token) - LONGEST // 2), LONGEST // 2)]
    words = [] if token.isalpha() else [p for p in _LETTERS.findall(token) if len(p) <= LONGEST or not _PLAIN.search(p)]
    return list(dict.fromkeys([*words, *cut, *_windows([p for p in _MARKS.split(token) if p])]))


def restored_words(token: str, model) -> tuple[str, ...]:
    """The words that a token of lower-case text stands for: itself without edge marks when it looks like a word."""
    core = token.strip(EDGES)
    if core.isalpha() and not _PLAIN.search(core):
        lead = token[0]
        if lead not in "!|(*":
            return (core,)
    if core.endswith("$$$"):
        core = core.rstrip("$")
        if core.isalpha() and not _PLAIN.search(core):
            return (core,)
    inner = token.rstrip(EDGES).lstrip(".,;:?\"'[]{}<>#%&_-~^`=/\\")
    if not _LETTER.search(inner):
        return ()
    if len(inner) > LONGEST:
        return tuple(dict.fromkeys(w for p in pieces(inner) for w in restored_words(p, model)))
    # a mark on its own before the word is punctuation as often as a letter: both readings are kept
    out = dict.fromkeys(restore(inner, model).split())
    if core.isalpha():
        out[core] = None
    return tuple(out)


def features(word: str) -> tuple[str, ...]:
    """The word and its beginnings of 4 to 6 letters, which inflected forms share."""
    return ("=" + word, *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)) if word else ()


def spaced(words: list[str]) -> list[str]:
    """Runs of four or more single characters, each as one token with blanks inside. Long runs are read in windows of half
    LONGEST letters that overlap by three quarters, so a word of up to 16 letters lies whole in one of them."""
    import numpy as np

    single = np.fromiter(map(len, words), np.int32, len(words)) == 1
    if single.sum() < 4:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    runs = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= 4]
    return [" ".join(words[i : min(i + LONGEST // 2, b)]) for a, b in runs for i in range(a, max(a + 1, b - 3), LONGEST // 8)]


@dataclass
class Scorer:
    """What the labels taught: counts of toxic and other sample documents by feature, and the map from evidence to score."""

    model: object
    counts: dict = field(default_factory=dict)
    base: float = 0.1
    slope: float = 0.0
    offset: float = -3.0
    prior: float = 2.0

    def weight(self, name: str, own: int | None = None) -> float:
        """Smoothed log odds over the base rate; own is the label of a document to leave out."""
        pos, neg = self.counts.get(name, (0, 0))
        pos, neg = pos - (own == 1), neg - (own == 0)
        return math.log((pos + self.prior * self.base) / (neg + self.prior * (1 - self.base))) - math.log(self.base / (1 - self.base))

    def tokens(self, text: str) -> set[str]:
        words = text.lower().split()
        return set(words) | set(spaced(words))

    def evidence(self, tokens: set[str], lookup, own: int | None = None) -> float:
        """The weights of all words that speak for toxicity, the strongest whole, the next a third of it, a fifth, and so
        on: mild words add up too. Of a word, its strongest feature counts."""
        if own is None:
            found = [w for w in map(lookup.__getitem__, tokens) if w]
        else:
            found = [max((self.weight(f, own) for f in names), default=0.0) for names in map(lookup.__getitem__, tokens) if names]
        return sum(max(x, 0.0) / (1 + 2 * k) for k, x in enumerate(sorted(found, reverse=True)))

    def names(self, token: str) -> tuple[str, ...]:
        return tuple(f for w in restored_words(token, self.model) for f in features(w) if f in self.counts)

    def token_weight(self, token: str) -> float:
        return max((w for f in self.names(token) if (w := self.weight(f)) > 0), default=0.0)

    def score(self, evidence: float) -> float:
        return sigmoid(self.slope * evidence + self.offset)


def _surprise(pos: int, neg: int, base: float) -> float:
    """Twice the log likelihood ratio of a feature's own rate to the base rate; 0 when its rate isn't above it."""
    n = pos + neg
    if pos <= n * base:
        return 0.0
    return 2 * (pos * math.log(pos / (n * base)) + (neg * math.log(neg / (n * (1 - base))) if neg else 0.0))


def _unexplained(pairs: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Each feature's counts less those of the features that continue it by a letter, or are the whole word."""
    left = {k: list(v) for k, v in pairs.items()}
    for name, counts in pairs.items():
        word = name[1:]
        parent = "^" + (word[:6] if name[0] == "=" else word[:-1])
        if parent in left:
            left[parent] = [max(0, a - b) for a, b in zip(left[parent], counts, strict=True)]
    return {k: (a, b) for k, (a, b) in left.items()}


def _signatures(batches: Iterator) -> Iterator:
    """(label, smallest hash of a text's 5-word shingles, text): near copies mostly agree in it."""
    import numpy as np
    for batch in batches:
        sets = (shingle_set(t.as_buffer().to_pybytes()).view(np.int64) for t in batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(s.min()) if len(s) else 0 for s in sets], pa.int64()), batch.column(1)], names=["label", "signature", "text"])


def train(docs: DataFrame, labels: DataFrame, train_filter=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, min_documents: int = 4, min_share: float = 0.001, min_surprise: float = 20.0, min_purity: float = 0.6) -> Scorer:
    """Learns from at most about max_labelled labelled rows, chosen by a hash of their id (the bound also bounds what
    is broadcast); the character model and with it the restoring of words is from all documents.

    A feature counts when at least min_documents and min_share of the sample's toxic documents have it, more often than
    the base rate explains (min_surprise: twice the log likelihood ratio; 20 is one in 100,000) and in most of its
    documents (min_purity); a beginning also in those that its known continuations leave: toxic documents with one word
    don't make all words that begin like it toxic. An id labelled
    more than once is toxic if any label says so; null labels and ids are left out. Of the sample's texts that agree in
    label and in the smallest hash of their shingles - repeated rows, near copies, and texts without words - one stays.
    Null and empty texts are texts without words; long ones are read whole. Without labels, as of empty tables, all
    scores are low and alike. Other columns are not read.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "toxicity")
    scorer = Scorer(character_model(docs, text_col).tolist())
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    known = (known.filter(train_filter(F.col("id"))) if train_filter else known).groupBy("id").agg(F.max("label").cast("int").alias("label"))
    n = known.count()
    if not n:
        return scorer
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, max_labelled / n) * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")  # chosen is bounded by max_labelled
    # near copies would lend every word of theirs the weight of many documents: of a signature and label one row stays
    signed = rows.mapInArrow(_signatures, "label int, signature bigint, text binary")
    sample = ws.save(signed.groupBy("label", "signature").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("label", F.col("x.text").alias("text")), "sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        scorer.offset = 3.0 if positive else -3.0
        return scorer
    scorer.base = positive / (positive + negative)
    model = spark.sparkContext.broadcast(scorer.model)

    def tally(wanted=None):
        def run(batches: Iterator) -> Iterator:
            own, seen = Scorer(model.value), Counter()
            words = WordCache(lambda t: tuple(f for w in restored_words(t, own.model) for f in features(w) if wanted is None or f in wanted.value), 50_000)
            for batch in batches:
                for text in batch.column(0):
                    seen.update({f for t in own.tokens(text.as_buffer().to_pybytes().decode("utf-8", "replace")) for f in words[t]})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["name", "n"])

        return run

    def counts(label: int, wanted=None) -> DataFrame:
        return sample.filter(F.col("label") == label).select("text").mapInArrow(tally(wanted), "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))

    # at most (features of a document) / min_share names pass this filter, whatever the corpus
    pos = {r[0]: r[1] for r in counts(1).filter(F.col("n") >= max(min_documents, min_share * positive)).collect()}
    neg = {r[0]: r[1] for r in counts(0, spark.sparkContext.broadcast(frozenset(pos))).collect()} if pos else {}
    pairs = {k: (p, neg.get(k, 0)) for k, p in pos.items()}
    unexplained = _unexplained(pairs)
    mostly = lambda p, n: p >= min_purity * (p + n)
    scorer.counts = {k: v for k, v in pairs.items() if mostly(*v) and (sum(unexplained[k]) < 3 or mostly(*unexplained[k])) and _surprise(*v, scorer.base) >= min_surprise}
    sent = spark.sparkContext.broadcast(scorer)

    def held_out(batches: Iterator) -> Iterator:
        own = sent.value
        lookup = WordCache(own.names, 100_000)
        for batch in batches:
            labels_ = batch.column(0).to_pylist()
            out = [own.evidence(own.tokens(t.as_buffer().to_pybytes().decode("utf-8", "replace")), lookup, y) for t, y in zip(batch.column(1), labels_, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["label", "evidence"])

    points = sample.mapInArrow(held_out, "label int, evidence double").groupBy("label", F.round("evidence", 2).alias("evidence")).count().collect()
    scorer.slope, scorer.offset = _logistic([(r["evidence"], r["label"], r["count"]) for r in points])
    ws.drop("sample")
    return scorer


def _logistic(points: list[tuple[float, int, int]], rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve through weighted points (Newton's method with a small ridge)."""
    a, b = 1.0, -3.0
    for _ in range(rounds):
        ga, gb, haa, hab, hbb = -ridge * a, 0.0, ridge, 0.0, 1e-6
        for x, y, n in sorted(points):
            p = sigmoid(a * x + b)
            g, h = n * (y - p), n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + g * x, gb + g, haa + h * x * x, hab + h * x, hbb + h
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = max(0.0, a + step * da), b + step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return a, b


def score_column(scorer: Scorer, spark: SparkSession, text_col: str = "text") -> Column:
    """The score of a text column. Only the texts go to Python; a row's other columns wait in the JVM."""
    sent = spark.sparkContext.broadcast(scorer)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        lookup = WordCache(own.token_weight, 150_000)
        for batch in batches:
            yield pa.array([own.score(own.evidence(own.tokens(t.as_buffer().to_pybytes().decode("utf-8", "replace")), lookup)) for t in batch], pa.float64())

    return F.arrow_udf(scored, "double")(utf8(text_col))


def score_documents(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, extra columns, score. Null and empty texts have no evidence and score as such; long
    texts are read whole; repeated rows score alike, and ids are only carried. An empty table gives an empty result."""
    return docs.select(F.col(id_col), *(c.alias(k) for k, c in (extra or {}).items()), score_column(scorer, docs.sparkSession, text_col).alias("score"))


def restore_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored): the text with every token replaced by its reading; unreadable tokens stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def restored(batches: Iterator) -> Iterator:
        cache = WordCache(lambda t: " ".join(restored_words(t, sent.value)) or t)
        for batch in batches:
            out = []
            for text in batch.column(1):
                words, parts, i = text.as_buffer().to_pybytes().decode("utf-8", "replace").lower().split(), [], 0
                while i < len(words):
                    j = i
                    while j < len(words) and len(words[j]) == 1 and j - i < LONGEST // 2:
                        j += 1
                    if j - i >= 4:
                        parts.append(cache[" ".join(words[i:j])])
                        i = j
                    else:
                        parts.append(cache[words[i]])
                        i += 1
                out.append(" ".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "restored"])

    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(restored, f"id {dict(rows.dtypes)['id']}, restored string").withColumnRenamed("id", id_col)
