"""Token ids in Parquet list columns: delta-encoded ids, set row groups and page indexes, selective reads."""

from __future__ import annotations

import json
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8

SHARD_SCHEMA = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

MARKS = string.punctuation.encode()
#: Text that is encoded at a time.
TEXT_BYTES = 8 << 20
#: Tokenizers by path, and ids by word, kept by a worker from task to task.
_LOADED: dict = {}


def _byte_letters() -> list[str]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others take the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def _encoder(path: str, limit: int = 300_000, together: int = 256):
    """Returns encode(texts: a pyarrow string array, end) -> (all ids, number of ids of each text).

    A text is cut at ASCII white space, which the tokenizer drops and never lets a piece cross, so the ids of the
    words in order are the ids of the text. It also lowers case, so A-Z are lowered first (texts that hold a mark of its
    special tokens excepted, whose case counts). The distinct words of the texts are looked up in a cache of two
    generations, at most `limit` words each, the older of which is dropped when the younger is full; then all ids are
    gathered at once. A new word that is letters alone, but for marks at its end, is one piece and one piece of marks:
    such pieces go to the vocabulary's merges, `together` at once, past the rest of the tokenizer. All other words go
    through the whole tokenizer.
    """
    if path in _LOADED:
        return _LOADED[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    tokenizer, cache, letters, older = Tokenizer.from_file(path), {}, _byte_letters(), {}
    settings = json.loads(tokenizer.to_str())
    lowers = "Lowercase" in json.dumps(settings.get("normalizer"))
    plain = settings["pre_tokenizer"] is not None and settings["model"].get("dropout") is None and lowers
    merges = Tokenizer(tokenizer.model)  # one vocabulary in memory
    merges.pre_tokenizer = WhitespaceSplit()
    four = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def whole(word: bytes) -> bytes:
        return b"".join([four[i] for i in tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids])

    def one_piece(stem: bytes) -> str | None:
        """The stem's bytes as letters of the vocabulary, if the tokenizer takes it for one piece."""
        text = stem.decode("utf-8", "replace")
        low = text.lower()  # as a whole; the tokenizer lowers letter by letter, which a final sigma shows
        if text.isalpha() and low.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
            return "".join(map(letters.__getitem__, low.encode()))
        return None

    def learn(words: list[bytes]) -> None:
        stems, cut = {}, []
        for word in words:
            found = older.get(word)
            if found is not None:
                cache[word] = found
                continue
            stem = word.rstrip(MARKS)
            if stem not in cache and stem not in stems:
                found = older.get(stem)
                if found is None:
                    text = None if not plain else stem.decode() if stem.isalpha() and stem.islower() else one_piece(stem)
                    if text is None:
                        cache[word] = whole(word)
                        continue
                    stems[stem] = text
                else:
                    cache[stem] = found
            if len(stem) < len(word):
                cut.append((word, stem, word[len(stem) :]))
        pieces, texts = list(stems), list(stems.values())
        for i in range(0, len(pieces), together):
            part = pieces[i : i + together]
            found = merges.encode(" ".join(texts[i : i + together]), add_special_tokens=False)
            data, edges = np.array(found.ids, "<u4").tobytes(), (4 * np.searchsorted(found.word_ids, np.arange(len(part) + 1))).tolist()
            cache.update(zip(part, map(data.__getitem__, map(slice, edges, edges[1:])), strict=False))
        for word, stem, tail in cut:
            marks = cache.get(tail)
            if marks is None:
                marks = cache[tail] = whole(tail)
            cache[word] = cache[stem] + marks

    def ids_of(words: list[bytes]) -> list[bytes]:
        nonlocal cache, older
        parts = list(map(cache.get, words))
        if None in parts:
            if len(cache) > limit:
                cache, older = {}, cache
            places = [i for i, part in enumerate(parts) if part is None]
            learn([words[i] for i in places])
            for i in places:
                parts[i] = cache[words[i]]
        return parts

    def encode(texts, end: int | None):
        if lowers:
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        cut = pc.ascii_split_whitespace(texts)
        found = cut.flatten().dictionary_encode()
        parts = ids_of(found.dictionary.cast(pa.binary()).to_pylist())
        parts.append(four[end] if end is not None else b"")
        pool = np.frombuffer(b"".join(parts), "<u4")
        lengths = np.fromiter(map(len, parts), np.int32, len(parts)) // np.int32(4)
        starts = np.cumsum(lengths) - lengths
        edges = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        order = np.insert(found.indices.to_numpy(), edges[1:], len(parts) - 1)  # the end stands after each text's last word
        own = lengths[order]
        after = np.cumsum(own)
        shift = (starts[order] - after + own).astype(np.int32)  # from an id's place among all to its place in the pool
        places = np.arange(after[-1] if len(after) else 0, dtype=np.int32)
        places += np.repeat(shift, own)
        ids = pool[places]
        last = after[edges[1:] + np.arange(len(edges) - 1)]
        return ids, np.diff(last, prepend=0)

    _LOADED[path] = encode
    return encode


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Rows (shard, doc_id, local_start, n_tokens, ids) in ascending id order within and across shards.

    Documents are dealt to shards by ranges of id, so shard k holds only smaller ids than shard k+1 and no shuffle
    follows. Null text is an empty text: only the end id. Null ids come first. Repeated ids stay together, in an
    order by text, so reruns agree.
    """

    def encoded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encode, shard, start = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).view(pa.string())
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < batch.num_rows:  # about as much text at a time, so that long texts never meet in one output batch
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
                ids, sizes = encode(texts[at:stop], end_id)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                n = stop - at
                arrays = [pa.array([shard] * n, pa.int32()), batch.column(0).slice(at, n), pa.array(start + offsets[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))]
                yield pa.RecordBatch.from_arrays(arrays, names=SHARD_SCHEMA.names)
                start, at = start + int(offsets[-1]), stop

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    return dealt.sortWithinPartitions("doc_id", "text").mapInArrow(encoded, SHARD_SCHEMA)


def write_tokens(encoded: DataFrame, path: str, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes one file per shard.

    Version 2 pages with dictionaries off for every column: ints are then delta-encoded with bit packing, which suits
    both ids and rising offsets. Row groups and pages have the given sizes, and the footer's column and offset
    indexes let a reader skip to the pages of an id range, and read the metadata columns without the ids.
    """
    encoded.write.options(
        **{"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": 4096, "parquet.columnindex.truncate.length": 16}
    ).parquet(path)


def token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document, without reading ids.

    Only the totals of the shards, one row each, are summed in order and sent to all tasks.
    """
    rows = spark.read.schema(SHARD_SCHEMA).parquet(path)
    return _placed(rows.select("shard", "doc_id", "local_start", "n_tokens"), path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents with their ids, for a range of doc_id (the file's page index skips the rest)."""
    rows = spark.read.schema(SHARD_SCHEMA).parquet(path)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return _placed(rows, path)


def _placed(rows: DataFrame, path: str) -> DataFrame:
    from pyspark.sql import Window

    # the totals come from the whole files, also when rows are a range of them
    totals = rows.sparkSession.read.schema(SHARD_SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_start"))  # a row per shard
    placed = rows.join(F.broadcast(starts), "shard")  # bounded by the number of shards
    return placed.withColumn("start", F.col("shard_start") + F.col("local_start")).drop("shard", "shard_start", "local_start")


def ids_crc32(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Replaces the ids by ids_crc32: the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    keep = [c for c in rows.columns if c != ids_col]
    schema = T.StructType([f for f in rows.schema.fields if f.name != ids_col] + [T.StructField("ids_crc32", T.LongType())])

    def digest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            values, offsets = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), column.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(values)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(crc, pa.int64())], names=schema.names)

    return rows.mapInArrow(digest, schema)
