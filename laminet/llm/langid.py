"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to ORDER with the counts of the byte that follows. A byte seen n
times of t after a context of d different bytes has probability n / (t + d) there; one not seen costs the escape
d / (t + d) and is looked for after the next shorter context, at last with 1/256. A context that the language has never
seen is passed over free of charge. The counts are frozen, so the cost of each (context, byte) is a constant: those
of all known ones are worked out once, and a text is scored by looking up each of its positions.

The models are fitted on the driver on a bounded sample: at most SAMPLE_DOCS texts and SAMPLE_BYTES bytes a language,
those with the lowest hashes of the id. Everything that is scored is scored whole.

Cases: a null text or one without a letter is `und` with score 0; ties go to the first language by code point; an empty
table gives an empty one; without a single labelled text every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from laminet.llm.common import own_name, pieces, with_fields

ORDER = 3
#: Bytes of a long text that are priced at once.
WINDOW = 1 << 18
SAMPLE_DOCS = 400
SAMPLE_BYTES = 1 << 20
#: A text that its best model codes worse than this many bits a byte (a uniform code's) belongs to no language.
REJECT_BITS = 8.0

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Open addressing from 64-bit keys to row numbers, read with whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys.astype(np.uint64)
        at = self._home(self.keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.slot[at[left]] < 0
            _, first = np.unique(np.where(free, at[left], -1 - np.arange(len(left), dtype=np.int64)), return_index=True)
            put = first[free[first]]
            self.slot[at[left[put]]] = left[put]
            left = np.delete(left, put)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it isn't known."""
        at = self._home(keys)
        row = self.slot[at]
        todo = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            row[todo] = self.slot[at[todo]]
            todo = todo[(row[todo] >= 0) & (self.keys[row[todo]] != keys[todo])]
        return row


def grams(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all positions with n - 1 bytes before them in their own text: where, and those bytes with the one there as a number.

    The number has a marker bit above its bytes, so those of different lengths differ.
    """
    inside = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    key = np.full(len(data), 1, np.uint64)
    for back in range(n - 1, -1, -1):
        key[back:] = (key[back:] << np.uint64(8)) | data[: len(data) - back]
    where = np.flatnonzero(inside >= n - 1)
    return where, key[where]


@dataclass
class Model:
    """known[k]: keys of the (context of order k, byte) seen by any language; cost[k]: bits by language; contexts[k] and
    escape[k]: the contexts of order k and what it costs each language to leave them."""

    langs: list[str]
    known: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def lookups(self) -> tuple[list[Lookup], list[Lookup]]:
        if "tables" not in self.__dict__:
            self.tables = [Lookup(k) for k in self.known], [Lookup(k) for k in self.contexts]
        return self.tables

    def price(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Bits by language of each (context of that order, byte), by escapes where it isn't known."""
        if order < 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        known, contexts = self.lookups()
        row = known[order].find(keys)
        out = self.cost[order][row]
        if len(miss := np.flatnonzero(row < 0)):
            at = contexts[order].find(keys[miss] >> np.uint64(8))
            lower = shorter(keys[miss], order)
            out[miss] = np.where((at >= 0)[:, None], self.escape[order][at], 0.0) + self.price(order - 1, lower)
        return out

    def code_lengths(self, data: np.ndarray, starts: np.ndarray, most: int = WINDOW) -> np.ndarray:
        """Bits of each text by language. starts: where the texts start in data, and its end. A text of more than `most` bytes is priced in
        windows, each after the ORDER bytes before it, so that arrays stay small whatever a text's length."""
        if len(long := np.flatnonzero(np.diff(starts) > most)):
            total = np.zeros((len(starts) - 1, len(self.langs)))
            rest = np.setdiff1d(np.arange(len(starts) - 1), long)
            for i in long.tolist():
                text = data[starts[i] : starts[i + 1]]
                for at in range(0, len(text), most):
                    before = min(at, ORDER)
                    window = text[at - before : at + most]
                    total[i] += self._priced(window, np.array([0, len(window)]), before)[0]
            if len(rest):
                ends = np.concatenate([[0], np.cumsum(np.diff(starts)[rest])])
                total[rest] = self._priced(np.concatenate([data[starts[i] : starts[i + 1]] for i in rest.tolist()]), ends)
            return total
        return self._priced(data, starts)

    def _priced(self, data: np.ndarray, starts: np.ndarray, skip: int = 0) -> np.ndarray:
        """code_lengths of texts at once; the first skip bytes of data are context only."""
        total = np.zeros((len(starts) - 1, len(self.langs)))
        if not len(data):
            return total
        bits = np.empty((len(data), len(self.langs)), np.float32)
        where, keys = grams(data, starts, ORDER + 1)
        bits[where] = self.price(ORDER, keys)
        inside = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
        for order in range(ORDER):  # the first bytes of a text have shorter contexts
            first = np.flatnonzero(inside == order)
            key = np.full(len(first), 1, np.uint64)
            for back in range(order, -1, -1):
                key = (key << np.uint64(8)) | data[first - back]
            bits[first] = self.price(order, key)
        bits[:skip] = 0
        full = np.flatnonzero(np.diff(starts) > 0)
        total[full] = np.add.reduceat(bits, starts[full], axis=0, dtype=np.float64)
        return total


def shorter(keys: np.ndarray, order: int) -> np.ndarray:
    """The (context, byte) keys of one order less: the context's oldest byte goes."""
    bits = np.uint64(8 * order)
    return (keys & ((np.uint64(1) << bits) - np.uint64(1))) | (np.uint64(1) << bits)


def fit(texts: dict[str, list[bytes]]) -> Model:
    """texts: samples by language."""
    langs = sorted(texts)
    counted = []
    for lang in langs:
        joined = np.frombuffer(b"".join(texts[lang]), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[lang]])]).astype(np.int64)
        counted.append([np.unique(grams(joined, starts, k + 1)[1], return_counts=True) for k in range(ORDER + 1)])
    model = Model(langs, [], [], [], [])
    for k in range(ORDER + 1):
        keys = np.unique(np.concatenate([c[k][0] for c in counted]))
        contexts = np.unique(keys >> np.uint64(8))
        cost = np.zeros((len(keys), len(langs)))
        escape = np.zeros((len(contexts), len(langs)))
        below = model.price(k - 1, shorter(keys, k)) if k else np.full((len(keys), len(langs)), 8.0)
        place = np.searchsorted(contexts, keys >> np.uint64(8))
        for j, c in enumerate(counted):
            own, n = c[k]
            at = np.searchsorted(contexts, own >> np.uint64(8))
            total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            seen = total > 0
            escape[seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
            cost[:, j] = escape[place, j] + below[:, j]
            cost[np.searchsorted(keys, own), j] = -np.log2(n / (total[at] + kinds[at]))
        for have, new in ((model.known, keys), (model.cost, cost), (model.contexts, contexts), (model.escape, escape)):
            have.append(new)
        model.__dict__.pop("tables", None)
    return model


def sample(labelled: DataFrame, doc_id: str, text: str, lang: str, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """At most docs texts and size bytes a language (one text of a language at least), with the lowest hashes of their ids.

    Numbers of texts are counted first, so that only about twice what is wanted is sorted.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(doc_id)).alias("h")).where("t is not null and t <> '' and l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * docs + 50) / n))])
    w = Window.partitionBy("l").orderBy("h", "t")
    near = rows.where((F.col("h") / F.lit(2.0**64) + 0.5) <= F.element_at(share, F.col("l")))
    near = near.withColumns({"k": F.row_number().over(w), "b": F.sum(F.octet_length("t")).over(w)})
    out: dict[str, list[bytes]] = {}
    for r in near.where((F.col("k") == 1) | ((F.col("k") <= docs) & (F.col("b") <= size))).select("l", "t").toLocalIterator():
        out.setdefault(r["l"], []).append(r["t"].encode())
    return out


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred string, score double (the share of the best language's probability among all) and bits double (its
    code length a byte); the three names get underscores where the table has them already. Only text is looked at."""
    names = [own_name(docs, n) for n in ("lang_pred", "score", "bits")]
    letter = own_name(docs, "letter")
    marked = docs.withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in pieces(batches, text, most_bytes=1 << 18):
            n = part.num_rows
            col = part.column(part.schema.get_field_index(text))
            best, score, bits = np.full(n, -1), np.zeros(n), np.full(n, np.nan)
            ok = np.array(part.column(part.schema.get_field_index(letter)).to_pylist(), bool)
            if m is not None and ok.any():
                whole = pa.array([t if k else None for t, k in zip(col.to_pylist(), ok, strict=True)], pa.large_string()).fill_null("")
                ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + n + 1]
                data = np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[-1]]
                lengths = m.code_lengths(data, ends - ends[0])
                best = np.where(ok, lengths.argmin(1), -1)
                low = lengths.min(1, keepdims=True)
                score = np.where(ok, 1 / np.exp2(np.minimum(0, low - lengths)).sum(1), 0.0)
                bits = np.where(ok, low[:, 0] / np.maximum(1, np.diff(ends)), np.nan)
            new = [pa.array(["und" if b < 0 else m.langs[b] for b in best], pa.string()), pa.array(score, pa.float64()), pa.array([None if np.isnan(b) else float(b) for b in bits], pa.float64())]
            kept = [i for i, f in enumerate(part.schema.names) if f != letter]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *new], [*(part.schema.names[i] for i in kept), *names])

    fields = [f for f in marked.schema.fields if f.name != letter]
    schema = T.StructType(fields).add(names[0], "string").add(names[1], "double").add(names[2], "double")
    return marked.mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """Whether the document takes no part in learning: crc32 of the id as text, modulo 4, is 2 (a null id learns nothing)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def trained(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The model that the labelled documents which aren't held out give."""
    texts = sample(docs.where(~held_out(F.col(doc_id))), doc_id, text, lang)
    return fit(texts) if texts else None
