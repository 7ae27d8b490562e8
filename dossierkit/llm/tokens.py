"""Problem 7: encoding every text with a public byte-level BPE.

Content-defined chunk reuse: rolling-hash chunks that texts share are encoded
once, wherever they occur. A chunk's tokens hold only between its first and last
*sure* boundary (a blank between two letters or digits, at which the tokenizer's
pattern always parts, whatever stands further away); the stretch from the last
sure boundary of one chunk to the first of the next is encoded again over the
join. So the ids agree exactly with those of the whole text. A chunk without a
sure boundary is carried whole into the re-encoded stretch. Where only the number
of tokens is asked for, texts are encoded whole: chunks would cost more than they save.

Defined cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; exact duplicate rows give one row; further
columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import content_cuts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Sizes of chunks in bytes.
LEAST, AVERAGE, MOST = 512, 1024, 8192

_SURE = re.compile(r"(?<=[A-Za-z0-9À-ÖØ-öø-ÿ]) (?=[A-Za-z0-9À-ÖØ-öø-ÿ])")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of ``path``, once a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_type(path: str) -> type:
    """The narrowest type that holds every id of the vocabulary."""
    return np.uint16 if encoder(path).n_vocab <= 1 << 16 else np.int32


def sure_parts(piece: str) -> tuple[str, str | None, str]:
    """(head, core, tail) of a chunk; core is None where no sure boundary is found."""
    first = _SURE.search(piece)
    if first is None:
        return piece, None, ""
    a = b = first.start()
    for back in (64, 1024, len(piece)):
        for m in _SURE.finditer(piece, max(a, len(piece) - back)):
            b = m.start()
        if b > a:
            break
    return piece[:a], piece[a:b], piece[b:]


def _chunk_rows(with_piece: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, whole, seq, chunk, piece = [], [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = t.encode()
                mark = None if with_piece else xxhash.xxh3_128_digest(raw)
                start = 0
                for i, end in enumerate(content_cuts(np.frombuffer(raw, np.uint8), LEAST, AVERAGE, MOST)):
                    part = raw[start:end]
                    chunk.append(xxhash.xxh3_128_digest(part))
                    if with_piece:
                        piece.append(part)
                    else:
                        owner.append(k)
                        whole.append(mark)
                        seq.append(i)
                    start = end
            if with_piece:
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.binary()), pa.array(piece, pa.binary()).cast(pa.string())], ["chunk", "piece"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner, pa.int64()), pa.array(whole, pa.binary()), pa.array(seq, pa.int32()), pa.array(chunk, pa.binary())],
                    ["doc_id", "whole", "seq", "chunk"],
                )

    return run


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = encoder(path).encode_ordinary, id_type(path)
        for batch in batches:
            heads, cores, tails, sizes = [], [], [], []
            for piece in batch.column(1).to_pylist():
                head, core, tail = sure_parts(piece)
                ids = enc(core) if core else []
                heads.append(head)
                tails.append(tail)
                sizes.append(-1 if core is None else len(ids))
                cores.append(np.asarray(ids, width).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.binary()), pa.array(heads, pa.string()), pa.array(cores, pa.binary()), pa.array(tails, pa.string()), pa.array(sizes, pa.int32())],
                ["chunk", "head", "core", "tail", "size"],
            )

    return run


def _repair(path: str):
    """Put the chunks of each text together and encode again over the joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = encoder(path).encode_ordinary, id_type(path)
        for batch in batches:
            lists = batch.column(1)
            parts = lists.flatten()
            seq, heads, cores, tails, sizes = (parts.field(i).to_pylist() for i in range(5))
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ends, out = [0], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                pending, total, last = "", 0, -1
                for j in range(a, b):
                    if seq[j] == last:  # an exact duplicate row
                        continue
                    last = seq[j]
                    pending += heads[j]
                    if sizes[j] < 0:
                        continue
                    ids = enc(pending) if pending else []
                    total += len(ids) + sizes[j]
                    out.append(np.asarray(ids, np.int32))
                    out.append(np.frombuffer(cores[j], width).astype(np.int32))
                    pending = tails[j]
                ids = enc(pending) if pending else []
                total += len(ids)
                out.append(np.asarray(ids, np.int32))
                ends.append(ends[-1] + total)
            values = np.concatenate(out) if out else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))], ["doc_id", "ids"])

    return run


def _count(path: str):
    """Tokens of each text; one that this worker met before is not encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path).encode_ordinary
        known: dict[bytes, int] = {}
        for batch in batches:
            whole, n = [], []
            for t in batch.column(1).to_pylist():
                mark = xxhash.xxh3_128_digest(t.encode())
                if mark not in known:
                    if len(known) > 500_000:
                        known.clear()
                    known[mark] = len(enc(t))
                whole.append(mark)
                n.append(known[mark])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "whole", "n_tokens"])

    return run


def encode(documents: DataFrame, path: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every document, or (doc_id, n_tokens long) with ``counts_only``."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    filled = texts.where(F.col("text").isNotNull() & (F.col("text") != ""))
    blank = texts.where(F.col("text").isNull() | (F.col("text") == ""))
    if counts_only:  # nothing is kept but the number: no text is shuffled for it
        counted = filled.mapInArrow(_count(path), "doc_id long, whole binary, n_tokens long").distinct().select("doc_id", "n_tokens")
        return counted.unionByName(blank.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).distinct())
    # partial aggregation keeps one copy of a chunk per map task before anything is shuffled
    chunks = filled.mapInArrow(_chunk_rows(True), "chunk binary, piece string").groupBy("chunk").agg(F.any_value("piece").alias("piece"))
    coded = chunks.mapInArrow(_encode_chunks(path), "chunk binary, head string, core binary, tail string, size int")
    uses = filled.mapInArrow(_chunk_rows(False), "doc_id long, whole binary, seq int, chunk binary")
    # both sides stay hash-partitioned by chunk; AQE splits the uses of a hot chunk
    parts = uses.join(coded, "chunk").groupBy("doc_id", "whole").agg(F.array_sort(F.collect_list(F.struct("seq", "head", "core", "tail", "size"))).alias("parts"))
    full = parts.select("doc_id", "parts").mapInArrow(_repair(path), "doc_id long, ids array<int>")
    return full.unionByName(blank.select("doc_id", F.array().cast("array<int>").alias("ids")).distinct())
