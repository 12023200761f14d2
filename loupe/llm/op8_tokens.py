"""Token counts by a separator scan over flat, unindexed token files.

``write_token_files`` tokenises documents and joins their tokens, each document
ended by the end-of-document identifier, into flat streams of fixed blocks; a
block begins and ends anywhere in a document and no index of lengths is kept.
``count_tokens`` searches blocks for the identifier, vectorised and each on its
own, which gives the documents that end in a block, the tokens before its first
end and those behind its last. A prefix scan over the blocks of a stream then
stitches the documents that cross blocks, and numbers them.

Blocks are rows of a table in the shared folder, written by Spark, since workers
can't open a remote file themselves. Which documents a stream holds, in order,
stands in rows of its own; they carry no lengths.

Defined results: null and empty texts have no tokens; nulls and repeats of
``doc_id`` are documents of their own; a text that spells the identifier's name
is ordinary text; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loupe.llm.common import staged, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern and the free identifier that go with that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256

BLOCK = 1 << 16
#: Blocks after which a task begins another stream, so that a scan's order stays short.
STREAM = 1 << 8
#: Bytes of one text that the tokenizer takes at once; longer ones are cut between words.
TEXT = 1 << 16

_encoders: dict = {}


def encoder(ranks: bytes):
    """The tokenizer of a vocabulary file's contents, kept by the worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _encoders:
        parsed = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=parsed, special_tokens={})
    return _encoders[key]


def tokens_of(text: str | None, encode) -> np.ndarray:
    """The identifiers of a text. A cut stands between a word and the space before the next, where no piece reaches across."""
    if not text:
        return np.empty(0, np.uint16)
    if len(text) <= TEXT:
        return np.array(encode(text), np.uint16)
    parts, start = [], 0
    while start < len(text):
        end = start + TEXT
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        parts.append(np.array(encode(text[start:end]), np.uint16))
        start = end
    return np.concatenate(parts)


def write_token_files(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows of flat streams: (stream, place, tokens) for blocks, (stream, place, doc_id) for the order of documents."""
    with open(tokenizer, "rb") as f:  # one vocabulary file, read by the driver and sent with the tasks
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("stream", pa.string()), ("is_block", pa.bool_()), ("place", pa.int64()), ("tokens", pa.binary()), ("doc_id", pa.int64())])

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        task, streams, blocks, n_docs, held, size = TaskContext.get().partitionId(), 0, 0, 0, [], 0

        def block(flat: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([[f"{task:06d}-{streams:06d}"], [True], pa.array([blocks], pa.int64()), pa.array([flat.tobytes()], pa.binary()), pa.array([None], pa.int64())], schema=schema)

        for batch in source:
            ids, texts = batch.column("doc_id"), batch.column("text")
            names, places = [], []
            for i in range(batch.num_rows):
                flat = tokens_of(texts[i].as_py(), encode)
                held += [flat, np.array([END], np.uint16)]
                size += len(flat) + 1
                names.append(f"{task:06d}-{streams:06d}")
                places.append(n_docs)
                n_docs += 1
                if size >= BLOCK:
                    flat = np.concatenate(held)
                    while len(flat) >= BLOCK:
                        yield block(flat[:BLOCK])
                        blocks, flat = blocks + 1, flat[BLOCK:]
                    held, size = [flat], len(flat)
                if blocks >= STREAM:  # ends behind a document
                    if size:
                        yield block(np.concatenate(held))
                    streams, blocks, n_docs, held, size = streams + 1, 0, 0, [], 0
            n = len(names)
            yield pa.record_batch([names, [False] * n, pa.array(places, pa.int64()), pa.nulls(n, pa.binary()), ids], schema=schema)
        if size:
            yield block(np.concatenate(held))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(made, "stream string, is_block boolean, place long, tokens binary, doc_id long"), "tokens")


def scan_blocks(files: DataFrame) -> DataFrame:
    """For each block: how many documents end in it, the tokens of those that begin and end in it, and what is before and behind."""
    schema = pa.schema([("stream", pa.string()), ("place", pa.int64()), ("ends", pa.int64()), ("before", pa.int64()), ("inner", pa.list_(pa.int64())), ("behind", pa.int64())])

    def scanned(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for stream, place, data in zip(*(batch.column(c).to_pylist() for c in ("stream", "place", "tokens")), strict=True):
                flat = np.frombuffer(data, np.uint16)
                ends = np.flatnonzero(flat == END)
                if len(ends):
                    rows.append((stream, place, len(ends), int(ends[0]), np.diff(ends) - 1, len(flat) - 1 - int(ends[-1])))
                else:
                    rows.append((stream, place, 0, len(flat), np.empty(0, np.int64), len(flat)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.where("is_block").select("stream", "place", "tokens").mapInArrow(scanned, "stream string, place long, ends long, before long, inner array<long>, behind long")


def stitched(blocks: DataFrame) -> DataFrame:
    """(stream, ordinal, n_tokens) of every document, by a prefix scan over each stream's blocks."""
    w = Window.partitionBy("stream").orderBy("place")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    full = blocks.withColumn("first", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    # what a document has gathered in earlier blocks: what is behind the last end, and all blocks without an end since
    full = full.withColumn("run", F.coalesce(F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(earlier), F.lit(0)))
    open_run = Window.partitionBy("stream", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("last_behind", F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("behind")), ignorenulls=True).over(earlier), F.lit(0)))
    full = full.withColumn("carried", F.col("last_behind") + F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("before")).otherwise(0)).over(open_run), F.lit(0)))
    counts = F.concat(F.array(F.col("carried") + F.col("before")), F.col("inner"))
    return full.where("ends > 0").select("stream", "first", F.posexplode(counts).alias("i", "n_tokens")).select("stream", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens")


def count_tokens(files: DataFrame) -> DataFrame:
    """doc_id and n_tokens of every document in the files."""
    names = files.where("not is_block").select("stream", F.col("place").alias("ordinal"), "doc_id")
    return names.join(stitched(scan_blocks(files)), ["stream", "ordinal"]).select("doc_id", "n_tokens")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted from flat token files."""
    return count_tokens(write_token_files(table(spark, sf_dir, "documents")))


QUERIES = {"op8_tokens": op8_tokens}
ORACLES: dict[str, str] = {}
