"""Encoding a whole corpus with a public byte-level tokenizer, and decoding it.

Texts are cut into blocks of bounded size and every block is exploded into its
pre-tokens, positions kept as indices into the block's own distinct words. The
distinct words of all blocks meet in one global shuffle by word, where equal
words are neighbours and each is encoded once; its ids travel back to the blocks
that hold it, where texts are reassembled by position. A frequent word thus
moves once per block, never once per occurrence, and no table of words is
broadcast or collected.

The blocks are made twice, for words and for positions; both passes must see the
rows in the same order, so the input must be replayable (a table scan is). Each
pass states a hash of its block's words, and if they differ the job fails rather
than give wrong ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.pretokens import split

#: Bytes of text after which a block ends.
BLOCK_BYTES = 8 << 20


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary file; ``folder`` defaults to the installed package of public tokenizers."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _piece_encoder(path: str):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return own._core_bpe.encode_single_piece


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block id, rows) of at most ``block_bytes`` of text each, or of one longer text."""
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 32
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + block_bytes, "right")))
            yield block, batch.slice(at, to - at)
            block, at = block + 1, to


def _ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a ragged array, one after the other, and their lengths."""
    length = (offsets[1:] - offsets[:-1])[rows]
    if not len(rows):
        return values[:0], length
    end = np.cumsum(length)
    step = np.ones(end[-1], np.int64)
    full = np.flatnonzero(length)
    if not len(full):
        return values[:0], length
    first = end[full] - length[full]
    step[first] = offsets[:-1][rows[full]]
    step[first[1:]] -= offsets[:-1][rows[full[:-1]]] + length[full[:-1]] - 1
    return values[np.cumsum(step)], length


def _check(words: pa.Array) -> int:
    """Hash of a list of words."""
    words = words.cast(pa.binary())
    return xxhash.xxh64_intdigest(b"".join(bytes(memoryview(b)) for b in words.buffers()[1:] if b is not None)) >> 1 if len(words) else 0


def _words(block_bytes: int):
    def run(batches):
        for block, rows in blocks(batches, block_bytes):
            words, _ = split(rows["text"])
            distinct = words.dictionary_encode().dictionary.cast(pa.binary())
            n = len(distinct)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(np.full(n, _check(distinct))), pa.array(np.arange(n, dtype=np.int32)), distinct],
                ["block", "check", "word_no", "word"],
            )

    return run


def _positions(block_bytes: int):
    def run(batches):
        for block, rows in blocks(batches, block_bytes):
            words, offsets = split(rows["text"])
            coded = words.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(index)])
            checks = pa.array(np.full(len(rows), _check(coded.dictionary)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block)), checks, rows["doc_id"], lists], ["block", "check", "doc_id", "positions"])

    return run


def _encode(path: str):
    """Words arrive in order; each is encoded at its first row. One packed row leaves per block and batch."""

    def run(batches):
        encode, word, ids = _piece_encoder(path), None, b""
        for batch in batches:
            packed = []
            for own in batch["word"].to_pylist():
                if own != word:
                    word, ids = own, np.array(encode(own), np.int32).tobytes()
                packed.append(ids)
            block, no, check = (batch[c].to_numpy() for c in ("block", "word_no", "check"))
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=block[order[:1]] - 1))
            out: list[tuple] = []
            for own in np.split(order, cuts[1:]):
                lists = [packed[i] for i in own]
                out.append((int(block[own[0]]), int(check[own[0]]), no[own].tobytes(), np.array([len(x) // 4 for x in lists], np.int32).tobytes(), b"".join(lists)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["block", "check", "word_no", "sizes", "ids"]
            )

    return run


def _joined_bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _assemble(words: pa.Table, docs: pa.Table) -> pa.Table:
    no, sizes, ids = (_joined_bytes(words[c]) for c in ("word_no", "sizes", "ids"))
    offsets = np.zeros(len(no) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    row_of = np.full(len(no), -1, np.int64)
    row_of[no] = np.arange(len(no))
    positions = _joined_bytes(docs["positions"])
    checks = {*words["check"].unique().to_pylist(), *docs["check"].unique().to_pylist()}
    if len(positions) and (len(checks) != 1 or positions.max() >= len(no) or row_of.min() < 0):
        raise ValueError("the two passes over the texts saw different rows; write the input to a table first")
    values, length = _ragged(ids, offsets, row_of[positions])
    per_doc = np.zeros(len(docs) + 1, np.int64)
    np.cumsum(pc.binary_length(docs["positions"]).to_numpy() // 4, out=per_doc[1:])
    token = np.zeros(len(positions) + 1, np.int64)
    np.cumsum(length, out=token[1:])
    lists = pa.ListArray.from_arrays(pa.array(token[per_doc].astype(np.int32)), pa.array(values, pa.int32()))
    return pa.table({"doc_id": docs["doc_id"], "ids": lists})


def encode_corpus(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its text, without special tokens.

    Defined cases: null and empty texts have the empty list; strings of special
    tokens are ordinary text; repeated rows come out repeated; ids may be null
    or repeated; other columns are ignored.
    """
    path = path or tokenizer_path()
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = docs.mapInArrow(_words(block_bytes), "block long, check long, word_no int, word binary")
    encoded = (
        words.repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(_encode(path), "block long, check long, word_no binary, sizes binary, ids binary")
    )
    positions = docs.mapInArrow(_positions(block_bytes), "block long, check long, doc_id long, positions binary")
    return encoded.groupBy("block").cogroup(positions.groupBy("block")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def token_table(path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes in order of id, and their offsets."""
    by_id = {v: k for k, v in read_ranks(path or tokenizer_path()).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    offsets = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=offsets[1:])
    return np.frombuffer(b"".join(tokens), np.uint8), offsets


def decode_corpus(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): each id is joined to its bytes in the token table and these are strung together.

    The table is as large as the vocabulary, so every task reads its own copy.
    A null or empty list gives the empty text.
    """
    path = path or tokenizer_path()

    def run(batches):
        data, offsets = token_table(path)
        for batch in batches:
            ids = batch["ids"].fill_null([]) if batch["ids"].null_count else batch["ids"]
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            values, length = _ragged(data, offsets, flat)
            token = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(length, out=token[1:])
            lists = ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
            at = token[lists]
            texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], texts.cast(pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens) of every row in one pass without a shuffle; each block encodes its distinct words once."""
    path = path or tokenizer_path()

    def run(batches):
        encode = _piece_encoder(path)
        for _, rows in blocks(batches, block_bytes):
            words, offsets = split(rows["text"])
            coded = words.dictionary_encode()
            sizes = np.array([len(encode(w)) for w in coded.dictionary.to_pylist()], np.int64)
            token = np.zeros(len(words) + 1, np.int64)
            if len(words):
                np.cumsum(sizes[coded.indices.to_numpy(zero_copy_only=False)], out=token[1:])
            n = token[offsets[1:]] - token[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(n)], ["doc_id", "n_tokens"])

    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long")
