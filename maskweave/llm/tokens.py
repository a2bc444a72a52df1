"""Encoding a corpus with a public tokenizer (problem 8).

Texts are split into pre-tokens (words) with their positions.  Each block of
texts (one or a few Arrow batches) keeps its own list of distinct words, so that
what is exploded and shuffled by word is one row per block and distinct word
rather than one per occurrence.  Each word that is distinct in the whole corpus
is encoded once; its ids are joined back to the blocks, and every block puts the
ids of its texts together by position.

    texts -> blocks (words, positions) -> shared table
      words -> distinct -> ids -> joined to (block, word)   by word
      positions + dictionary of the block -> ids of a text  by block

The tokenizer's file is a parameter and is read by each Python worker once; it
must be at the same place on every machine.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.session import staged

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
BYTE_BPE_RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of byte-level BPE.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A block is closed from so many characters on; a longer text is a block of its own.
BLOCK_CHARS = 8_000_000
_PARTS = "block long, part int, doc_id {id}, row int, word string, body binary"


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # text that looks like a special token is ordinary text
    return t


@functools.cache
def _words():
    import regex

    return regex.compile(WORD_PATTERN).findall


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word rows (part 0: row, word) and text rows (part 1: doc_id, body = positions' words as uint32)."""
    from pyspark import TaskContext

    split, base, n = _words(), TaskContext.get().partitionId() << 32, 0
    ids: list = []
    bodies: list[bytes] = []
    index: dict[str, int] = {}
    chars = 0
    kind = None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal ids, bodies, index, chars, n
        if ids:
            block, k, m = base + n, len(index), len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(k + m, block)),
                    pa.array(np.repeat(np.array([0, 1], np.int32), [k, m])),
                    pa.concat_arrays([pa.nulls(k, kind), pa.array(ids, kind)]),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32), np.zeros(m, np.int32)])),
                    pa.array([*index, *[None] * m], pa.string()),
                    pa.array([*[None] * k, *bodies], pa.binary()),
                ],
                ["block", "part", "doc_id", "row", "word", "body"],
            )
            ids, bodies, index, chars, n = [], [], {}, 0, n + 1

    for batch in batches:
        kind = batch.column(0).type
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = split(text) if text else []
            ids.append(doc_id)
            bodies.append(np.array([index.setdefault(w, len(index)) for w in words], np.uint32).tobytes())
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield from flush()
    yield from flush()


def _encoder(path: str):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(words: pd.Series) -> pd.Series:
        return pd.Series([e.ids for e in _tokenizer(path).encode_batch(words.tolist(), add_special_tokens=False)])

    return encode


def _assembler(counts_only: bool):
    def assemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words.column("row").to_numpy())
        lists = words.column("word_ids").combine_chunks().take(pa.array(order))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        flat = lists.flatten().to_numpy()
        size = np.diff(ends)
        bodies = [np.frombuffer(b, np.uint32) for b in texts.column("body").to_pylist()]
        at = np.concatenate(bodies) if bodies else np.zeros(0, np.uint32)
        lens = size[at]
        cut = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        offsets = total[cut]
        if counts_only:
            return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(np.diff(offsets))})
        # position of every output id in flat: start of its word plus its place in the word
        source = np.repeat(ends[at] - total[:-1], lens) + np.arange(total[-1])
        ids = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat[source].astype(np.int32)))
        return pa.table({"doc_id": texts.column("doc_id"), "ids": ids.cast(pa.list_(pa.int32()))})

    return assemble


def _encoded(df: DataFrame, id_col: str, text: str, path: str, counts_only: bool) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    parts = staged(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_blocks, _PARTS.format(id=kind)), "tokens")
    words = parts.where("part = 0").select("block", "row", "word")
    ids = words.select("word").distinct().select("word", _encoder(path)("word").alias("word_ids"))
    dictionary = words.join(ids, "word").select(F.col("block").alias("of_block"), "row", "word_ids")
    texts = parts.where("part = 1").select("block", "doc_id", "body")
    out = f"doc_id {kind}, " + ("n_tokens long" if counts_only else "ids array<int>")
    made = texts.groupBy("block").cogroup(dictionary.groupBy("of_block")).applyInArrow(_assembler_safe(counts_only, kind), out)
    return made.withColumnRenamed("doc_id", id_col)


def _assembler_safe(counts_only: bool, kind: str):
    assemble = _assembler(counts_only)

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        if words.num_rows:
            return assemble(texts, words)
        # a block of empty texts has no words
        n = texts.num_rows
        last = {"n_tokens": pa.array(np.zeros(n, np.int64))} if counts_only else {"ids": pa.array([[]] * n, pa.list_(pa.int32()))}
        return pa.table({"doc_id": texts.column("doc_id"), **last})

    return run


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids): the ids of every text, without special tokens.

    A null or empty text gives an empty list.  Rows are kept one to one, repeated
    identifiers too.
    """
    return _encoded(df, id_col, text, path, counts_only=False)


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, n_tokens) of every text, by the same plan; the lists of ids are never made."""
    return _encoded(df, id_col, text, path, counts_only=True)


def token_bytes(spark, path: str = BYTE_BPE_RANKS) -> DataFrame:
    """(token, piece): the bytes of each id; a table of the vocabulary's fixed size."""
    with open(path, "rb") as f:
        pairs = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, f)]
    return spark.createDataFrame(pairs, "token int, piece binary")


def decode_corpus(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = BYTE_BPE_RANKS, block: int = 4096) -> DataFrame:
    """(id, text): texts of lists of ids, by a join with the token-byte table.

    Long lists are joined in blocks of ``block`` positions, so that no task holds
    a text's positions one row each.  An empty list gives an empty text.
    """
    table = F.broadcast(token_bytes(ids.sparkSession, path))  # the vocabulary: 50,256 rows, whatever the corpus
    pieces = (
        ids.withColumn("_row", F.monotonically_increasing_id())
        .select("_row", F.col(id_col).alias("_id"), F.posexplode_outer(ids_col).alias("_pos", "token"))
        .join(table, "token", "left")
    )
    blocks = pieces.groupBy("_row", "_id", F.floor(F.col("_pos") / block).alias("_block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "piece"))), lambda x: F.hex(x["piece"])), "").alias("_hex")
    )
    whole = blocks.groupBy("_row", "_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_hex"))), lambda x: x["_hex"]), "").alias("_hex"))
    return whole.select(F.col("_id").alias(id_col), F.decode(F.unhex("_hex"), "utf-8").alias("text"))


def n_tokens(c: Column) -> Column:
    """Length of a list of ids; 0 for null."""
    return F.coalesce(F.size(c), F.lit(0))
