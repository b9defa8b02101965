"""Token ids of a corpus by a public tokenizer: a table of distinct words, encoded once, joined back by position."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.session import spread, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of text in one block of documents, on average.
BLOCK_CHARS = 4_000_000
MOST_PARTS = 50_000

# The characters of the Unicode property White_Space and the tokenizer's rule for words.
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def words(text: Column) -> Column:
    """The words of a text, which put together are the text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _ranks(raw: bytes) -> list[tuple[bytes, int]]:
    return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, raw.splitlines())]


def _file(folder: str, vocabulary: str) -> bytes:
    """A vocabulary, read on the driver; tasks get its bytes (about 1 MB) and need no folder."""
    with open(f"{folder}/{vocabulary}", "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(raw: bytes):
    import tiktoken

    ranks = dict(_ranks(raw))
    # the split is done: whatever comes is one word
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def _encode(held):
    def run(batches):
        enc = encoder(held.value)
        for batch in batches:
            ids = [enc.encode_ordinary(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return run


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _split(text: pa.Array, sizes: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all rows, where each row's begin and end) of texts and the bytes of each of their words. The words lie in the texts' own buffer."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(sizes).to_numpy(zero_copy_only=False))])
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    lengths = sizes.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(lengths)]) + (offsets[0] if len(offsets) else 0)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(at.astype(np.int32)), text.buffers()[2] or pa.py_buffer(b"")), ends


def _distinct(batches):
    """(of, word): the distinct words of each block, as far as a batch shows."""
    for batch in batches:
        words, ends = _split(batch.column(1), batch.column(2))
        if not len(words):
            continue
        coded = words.dictionary_encode()
        pairs = np.unique(np.repeat(batch.column(0).to_numpy(), np.diff(ends)) * len(coded.dictionary) + coded.indices.to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(pairs // len(coded.dictionary)), coded.dictionary.take(pa.array(pairs % len(coded.dictionary)))], ["of", "word"])


def _place(documents: pa.Table, dictionary: pa.Table) -> pa.Table:
    """The ids of each document of a block, from the block's words."""
    flat, ends = _split(_flat(documents["text"]), _flat(documents["sizes"]))
    if not len(flat):
        return pa.table({"id": documents["id"], "ids": pa.array([[]] * documents.num_rows, pa.list_(pa.int32()))})
    at = pc.index_in(flat, value_set=_flat(dictionary["word"]))
    taken = _flat(dictionary["ids"]).take(at)
    token_ends = np.concatenate([[0], np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False))])
    ids = pa.ListArray.from_arrays(pa.array(token_ends[ends], pa.int32()), taken.flatten())
    return pa.table({"id": documents["id"], "ids": ids})


def token_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id_col and ids, the list of token ids of each text without special tokens; an empty list for an empty and for
    a null text. Rows of one id each give a row; a null id is kept; an empty table gives no rows; other columns are
    ignored. The strings of special tokens are ordinary text.

    Texts are split into words in the JVM, once: each is written with the bytes of its words, and cut by them where it is read again. Documents form blocks of about block_chars characters; the distinct words of each
    block meet the distinct words of all blocks, which are encoded once each, and come back to the block, where every
    position takes its word's ids. So what is shuffled by word is one row a block and word, not one an occurrence; a word
    that every text holds is one row a block.
    """
    rows = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    chars = rows.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-chars // block_chars))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.length("text")), F.lit(blocks)))
    sizes = F.transform(words(F.col("text")), F.octet_length)
    split = written(rows.withColumn("text", F.coalesce("text", F.lit(""))).select("block", "id", "text", sizes.alias("sizes")), "split")
    of_block = written(split.select("block", "text", "sizes").mapInArrow(_distinct, "of bigint, word string").distinct(), "words")
    encoded = of_block.select("word").distinct().mapInArrow(_encode(documents.sparkSession.sparkContext.broadcast(_file(folder, vocabulary))), "word string, ids array<int>")
    dictionary = of_block.join(encoded, "word")
    # a task a block, so that what a task reads does not grow with the corpus
    parts = min(MOST_PARTS, max(blocks, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = (
        split.repartition(parts, "block")
        .groupBy("block")
        .cogroup(dictionary.groupBy("of"))
        .applyInArrow(lambda d, w: _place(d, w), f"id {dict(documents.dtypes)[id_col]}, ids array<int>")
    )
    return placed.select(F.col("id").alias(id_col), "ids")


def pieces(spark, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, piece (bytes) of a vocabulary: one row an id, so of the vocabulary's own fixed size."""
    rows = [(b, bytearray(a)) for a, b in _ranks(_file(folder, vocabulary))]
    return spark.createDataFrame(rows, "id int, piece binary")


def decoded(ids: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col and text of each ids list: positions join the vocabulary (broadcast, of the vocabulary's size), and the
    pieces of a row are put together by position. Empty and null lists give the empty text. id_col is a key."""
    # partitioned by row before it is taken apart: positions come together again where they are, and only lists move
    spread_out = ids.select(id_col, "ids").repartition(id_col).select(id_col, F.posexplode_outer("ids").alias("pos", "id"))
    hit = spread_out.join(F.broadcast(pieces), "id", "left")
    joined = hit.groupBy(id_col).agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", F.hex("piece").alias("h"))))).alias("x"))
    return joined.select(id_col, F.decode(F.unhex(F.array_join(F.transform("x", lambda p: p["h"]), "")), "UTF-8").alias("text"))
