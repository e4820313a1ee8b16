"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a BPE model whose merges are the one split by which each token arises when
only lower ranks have been applied; whole pieces that are tokens are taken as they are. That gives the ids which merging
by lowest rank gives. Bytes are mapped to printable characters by the usual byte table; decoding takes the characters of
the vocabulary's tokens and reverses it. `round_trip` encodes and decodes in one pass over the batches, and `split_text` is for
those who decode ids that were cut anywhere, such as context windows.

Cases: a null text encodes like an empty one (no ids); an empty table gives an empty table; repeated rows are encoded
each; any other columns are carried through, and names of new columns get underscores where the table has them already.
Texts are encoded whole, however long. Decoding null ids gives empty bytes; an id outside the vocabulary raises.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from laminet.llm.common import own_name, pieces, with_fields


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def split_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is left of token's bytes after all merges of ranks lower than its own."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while True:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], limit)) < limit]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def vocabulary(ranks: dict[bytes, int]) -> dict[str, int]:
    """The tokens in byte-level characters, as the tokenizer has them."""
    chars = byte_characters()
    return {"".join(chars[b] for b in token): rank for token, rank in ranks.items()}


@lru_cache(maxsize=1)
def tokenizer(path: str, pattern: str):
    """Built once in each Python worker, which encodes in its one thread: Spark's tasks are the parallel ones."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    written = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and len(parts := split_of(token, ranks)) == 2:
            merges.append((written(parts[0]), written(parts[1])))
    tok = Tokenizer(models.BPE(vocabulary(ranks), merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


@lru_cache(maxsize=1)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, taken back from the tokens' characters by the reversed byte table, and where
    each id's start and how many they are (-1: there is no such id)."""
    back = {c: b for b, c in enumerate(byte_characters())}
    tokens = vocabulary(read_ranks(path))
    table: list[bytes | None] = [None] * (max(tokens.values()) + 1)
    for token, rank in tokens.items():
        table[rank] = bytes(back[c] for c in token)
    size = np.array([-1 if t is None else len(t) for t in table], np.int64)
    return np.frombuffer(b"".join(t or b"" for t in table), np.uint8), np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), size


def joined(ids: np.ndarray, ends: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lists of ids (list k: ids[ends[k]:ends[k + 1]]) one after the other, and where each list's bytes end."""
    data, start, size = byte_table(path)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or size[ids].min() < 0):
        raise ValueError("an id is outside the vocabulary")
    n = size[ids]
    upto = np.concatenate([[0], np.cumsum(n)])
    return data[np.repeat(start[ids] - upto[:-1], n) + np.arange(upto[-1])], upto[ends]


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    ends = [0]
    for v in values:
        ends.append(ends[-1] + len(v))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for v in values for x in v], kind))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Adds ids array<int> and, if offsets, starts and ends array<int>: the code points of the text that each id covers
    (an id that holds part of a character covers that character whole)."""
    names = [own_name(docs, n) for n in (("ids", "starts", "ends") if offsets else ("ids",))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        each = tok.encode_batch if offsets else tok.encode_batch_fast
        for part in pieces(batches, text, most_bytes=1 << 18):
            found = each([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()], add_special_tokens=False)
            new = [_lists([e.ids for e in found], pa.int32())]
            if offsets:
                spans = [e.offsets for e in found]
                new += [_lists([[s[k] for s in x] for x in spans], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])

    return docs.mapInArrow(run, with_fields(docs, *((n, "array<int>") for n in names)))


def _decoded(col: pa.Array, path: str) -> pa.Array:
    """The bytes of each list of ids."""
    col = col.fill_null([])
    sizes = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])
    data, ends = joined(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes, path)
    return pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds decoded binary: the bytes of the ids. keep: the columns to carry (all if None)."""
    rows = rows if keep is None else rows.select(*dict.fromkeys([*keep, ids]))
    name = own_name(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = _decoded(part.column(part.schema.get_field_index(ids)), path)
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, name])

    return rows.mapInArrow(run, with_fields(rows, (name, "binary")))


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, ids array<int> and decoded binary (what the ids decode to): one pass in one Python worker a task, and texts that
    aren't kept don't come back from it."""
    kept = docs.select(*keep)
    names = [own_name(kept, n) for n in ("ids", "decoded")]
    source = own_name(kept, "_t")
    rows = docs.select(*keep, docs[text].alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for part in pieces(batches, source, most_bytes=1 << 18):
            found = tok.encode_batch_fast([t or "" for t in part.column(len(keep)).to_pylist()], add_special_tokens=False)
            ids = _lists([e.ids for e in found], pa.int32())
            del found
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids, _decoded(ids, path)], [*keep, *names])

    return rows.mapInArrow(run, with_fields(kept, (names[0], "array<int>"), (names[1], "binary")))


def split_text(data: bytes) -> tuple[bytes, str, bytes]:
    """Bytes of ids cut out anywhere, as (rest of a character begun before, whole text, start of a character not ended).

    Joining the last of one part and the first of the next gives the split character back.
    """
    head = 0
    while head < min(3, len(data)) and data[head] & 0xC0 == 0x80:
        head += 1
    tail = len(data)
    for back in range(1, min(3, len(data) - head) + 1):
        b = data[-back]
        if b & 0xC0 == 0x80:
            continue
        need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
        tail = len(data) - back if need > back else tail
        break
    return data[:head], data[head:tail].decode("utf-8", errors="replace"), data[tail:]
