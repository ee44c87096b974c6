"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rename_free, utf8

BUCKETS = 4096


def has_letter(text: bytes) -> bool:
    """Whether any character is of a letter category (Lu, Ll, Lt, Lm, Lo); marks like ² or ½ are numbers."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def ngram_vector(text: bytes):
    """Square roots of the counts of the text's 1- to 3-byte grams by hash, at length 1."""
    import numpy as np

    c = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    two = (c[:-1] << np.uint32(8)) | c[1:]
    three = (two[:-1] << np.uint32(8)) | c[2:]
    grams = np.concatenate([c + np.uint32(1 << 24), two + np.uint32(2 << 24), three + np.uint32(3 << 24)])
    slots = ((grams * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    v = np.sqrt(np.bincount(slots, minlength=BUCKETS).astype(np.float32))
    return v / max(1e-9, float(np.sqrt((v * v).sum())))


def codewords(n: int, bits: int = 31, seed: int = 7):
    """n codewords of -1 and 1: the exhaustive code for up to five classes, else the best of random codes by the least
    distance between two words."""
    import numpy as np

    if n <= 1:
        return np.ones((max(n, 1), 1))
    if 2 ** (n - 1) - 1 <= bits:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns).T
    random, best = np.random.Generator(np.random.PCG64(seed)), None
    for _ in range(300):
        code = random.choice([-1, 1], (n, max(bits, int(10 * np.log2(n)))))
        # words of -1 and 1 differ in (bits - product) / 2 places
        least = int((code.shape[1] - np.triu(code @ code.T, 1)[np.triu_indices(n, 1)].max()) // 2)
        if (np.abs(code.sum(0)) < n).all() and (best is None or least > best[0]):
            best = (least, code)
    return best[1]


@dataclass
class LanguageModel:
    languages: list[str]
    code: object
    weights: object
    bias: object
    sharpness: float = 2.0

    def predict(self, vectors):
        """(index, probability, margin) of the nearest codeword under the logistic loss of the bits."""
        import numpy as np

        out = vectors @ self.weights + self.bias
        loss = np.logaddexp(0, -out[:, None, :] * self.code[None]).mean(2) * self.sharpness * self.code.shape[1] ** 0.5
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        ranked = np.sort(p, 1)
        return p.argmax(1), ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)


def _vectors(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        out = [ngram_vector(t.as_buffer().to_pybytes()).astype(np.float16).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "v"])


def train(docs: DataFrame, train_filter=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 3000, rounds: int = 150) -> LanguageModel | None:
    """Fits one binary classifier per bit of the code on about max_rows documents, spread evenly over languages and
    chosen by a hash of id and text, so that no id that repeats fills the sample. Counts of languages are from all rows.
    Rows with a null language or text teach nothing; rows that repeat as a whole are drawn together, and count as often
    as they stand. None if no language is known, as of an empty table. Other columns are not read."""
    import numpy as np

    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.filter(train_filter(F.col(id_col))) if train_filter else known
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang_col)).count().collect()}
    if not sizes:
        return None
    languages, each = sorted(sizes), max_rows / len(sizes)
    share = F.coalesce(*(F.when(F.col(lang_col) == k, F.lit(min(1.0, each / sizes[k]))) for k in languages))
    drawn = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(9)), F.lit(1 << 30)) < share * (1 << 30))
    rows = drawn.select(F.col(lang_col).alias("lang"), utf8(text_col).alias("text")).mapInArrow(_vectors, "lang string, v binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    if not rows:
        return None
    x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32)
    at = {k: i for i, k in enumerate(languages)}
    code = codewords(len(languages))
    y = code[[at[r[0]] for r in rows]].astype(np.float32)
    counts = np.bincount([at[r[0]] for r in rows], minlength=len(languages))
    share_ = (len(rows) / len(languages) / np.maximum(counts, 1))[[at[r[0]] for r in rows]].astype(np.float32)[:, None]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mean = x.mean(0)
    z, v, vb = x - mean, w.copy(), b.copy()
    for k in range(rounds):  # accelerated gradient steps
        g = -y / (1 + np.exp(np.clip(y * (z @ v + vb), -30, 30))) * share_ / len(rows)
        nw, nb = v - 8 * (z.T @ g + 1e-5 * v), vb - 2 * g.sum(0)
        m = k / (k + 3)
        v, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return LanguageModel(languages, code.astype(np.float32), w, b - mean @ w)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, ambiguous_below: float = 0.2) -> DataFrame:
    """One row per input row: id, extra columns, lang_pred, score, ambiguous.

    ambiguous: the two best languages' probabilities differ by less than ambiguous_below. A null text, and one without
    a letter, is `und` with score 0 and not ambiguous; so is every text when no language is known. Whole texts count,
    however long. Of languages that tie the first by code point is taken, and the text is ambiguous. Repeated rows are
    predicted alike, each with a row of its own; an empty table gives an empty result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}

    def predicted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = sent.value
        for batch in filter(len, batches):
            texts = [t.as_buffer().to_pybytes() for t in batch.column(0)]
            lang, score, doubt = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            at = [i for i, t in enumerate(texts) if has_letter(t)] if own else []
            for k in range(0, len(at), 256):
                part = at[k : k + 256]
                best, p, margin = own.predict(np.stack([ngram_vector(texts[i]) for i in part]))
                for i, a, b, c in zip(part, best.tolist(), p.tolist(), margin.tolist(), strict=True):
                    lang[i], score[i], doubt[i] = own.languages[a], min(1.0, b), c < ambiguous_below
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang), pa.array(score, pa.float64()), pa.array(doubt)], names=[*batch.schema.names[1:], "lang_pred", "score", "ambiguous"])

    rows = docs.select(utf8(text_col).alias(rename_free([id_col, *extra], "bytes")), F.col(id_col), *(c.alias(k) for k, c in extra.items()))
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[1:])
    return rows.mapInArrow(predicted, f"{kinds}, lang_pred string, score double, ambiguous boolean")
