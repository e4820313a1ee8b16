"""Near-duplicate documents by BagMinHash over bags of word shingles.

A document is the bag of its shingles of SHINGLE words (lower case, split at white space), with how often each occurs as
weights; one of fewer words has a single shingle of them all. The weighted Jaccard similarity of two bags is the sum of
the lesser weights over the sum of the greater ones.

Signature. The weight axis is cut at 1, 2, 4, 8 and so on; over each stretch each shingle has a Poisson process of its own, of a
rate equal to the stretch's length. A process's points come in ascending order, each with a register drawn at random and,
in the stretch where the shingle's weight ends, a place in it, found by halving the stretch again and again by the bits of a
hash; points beyond the weight don't count. A register keeps its least point: two bags share it with a probability equal to their
similarity. Points are made only up to the time by which all registers are likely to be filled, and
further where one is still empty.

Bands of ROWS registers propose candidates. Equal texts are one class from the start. In each bucket all are verified on their whole bags
against one member only, that whose buckets hold the most members in all. Members that fall out are tried with a few that stayed; those that
are still out then meet all texts of such buckets with which they share a rare shingle as an exact prefix filter asks. Members that a chain of
links already joins needn't meet. No bucket is capped and none compared in full.

Cases: null texts and texts without a word are like nothing and stay alone; rows that share an id but not the text are documents each,
rows equal in both are one; a null id takes part and sorts last, a class of null ids alone has a null class_id; an empty table
gives an empty one; texts are read whole, and those of a pair are bounded together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.llm.common import cut, discard, marked, marks, pieces
from laminet.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Times that what fell out of a bucket is tried with another of its members, before the prefix filter.
DRAWS = 1

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over whole arrays."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def bags(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, weight) of all bags, by document, and a fingerprint of each text's words (n x 2)."""
    words: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.lower().split() if t else []
        if 0 < len(w) < shingle:
            w += [""] * (shingle - len(w))
        words += w
        counts[i] = len(w)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros((len(texts), 2), np.int64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    inside = np.arange(len(h)) - np.repeat(first, counts)
    full = np.flatnonzero(inside <= np.repeat(counts, counts) - shingle)
    key = np.zeros(len(full), np.uint64)
    for k in range(shingle):
        key = mixed(key * _G + h[full + k])
    prints = np.zeros((len(texts), 2), np.int64)
    place = h * (np.uint64(2) * mixed(inside.astype(np.uint64) + _G) + np.uint64(1))
    some = np.flatnonzero(counts)
    prints[some, 0] = np.add.reduceat(mixed(place), first[some]).view(np.int64)
    prints[some, 1] = np.add.reduceat(mixed(place ^ _G), first[some]).view(np.int64)
    # Local document number above 48 bits of the hash: sorting these sorts the bags.
    packed = np.sort((doc[full].astype(np.uint64) << np.uint64(48)) | (key >> np.uint64(16)))
    new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    weight = np.diff(np.append(new, len(packed)))
    packed = packed[new]
    return (packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1), weight, prints


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """docs x registers: the least point of each register, inf throughout for an empty bag."""
    out = np.full(docs * registers, np.inf)
    mass = np.bincount(doc, weight, docs)
    limit = np.where(mass > 0, registers * (np.log(registers) + 3) / np.maximum(mass, 1e-300), 0.0)
    who = np.arange(len(doc))
    while len(who):
        stretch, length = 0, 1
        ids = who
        while len(ids):
            low = 0 if stretch == 0 else length
            _points(out, doc[ids], element[ids], weight[ids], low, length, stretch, limit, registers)
            stretch, length = stretch + 1, length if stretch == 0 else 2 * length
            ids = ids[weight[ids] > length]
        left = np.isinf(out.reshape(docs, registers)).any(1) & (mass > 0)
        limit = np.where(left, 2 * limit, 0.0)
        who = np.flatnonzero(left[doc])
    return out.reshape(docs, registers)


def _points(out, doc, element, weight, low, length, stretch, limit, registers) -> None:
    """Enters the points of one stretch of the weight axis, (low, low + length], into the registers."""
    state = mixed(element * _G + np.uint64(stretch + 1))
    x = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        r = mixed(state + np.uint64(step * int(_G) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log((r >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / length
        go = np.flatnonzero(x <= limit[doc])
        doc, weight, state, x = doc[go], weight[go], state[go], x[go]
        r = mixed(r[go] ^ _M2)
        counts = np.ones(len(doc), bool)
        cut_off = np.flatnonzero(weight < low + length)
        if len(cut_off):
            # Each bit keeps a half of the stretch; what is left is one unit of weight.
            place = low + 1 + (mixed(r[cut_off]) & np.uint64(length - 1)).astype(np.int64)
            counts[cut_off] = place <= weight[cut_off]
        register = ((r >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, (doc * registers + register)[counts], x[counts])


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """docs x bands: a hash of each band's registers and its number."""
    bits = signature.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G, (len(signature), bands)).copy()
    for k in range(bits.shape[2]):
        key = mixed(key * _G + bits[:, :, k])
    return key.view(np.int64)


def sign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, f1, f2, bands array<long>): fingerprints are null, and bands empty, for a text without words; th is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "t", most_bytes=1 << 20):
            doc, element, weight, prints = bags(part.column(1).to_pylist())
            some = np.bincount(doc, minlength=part.num_rows) > 0
            keys = band_keys(signatures(doc, element, weight, part.num_rows)) if len(doc) else np.zeros((part.num_rows, BANDS), np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            f = [pa.array(prints[:, k], pa.int64(), mask=~some) for k in (0, 1)]
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *f, bands], ["id", "th", "f1", "f2", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("th"))
    return rows.mapInArrow(run, "id long, th long, f1 long, f2 long, bands array<long>")


def similarity(a: list[str], b: list[str]) -> list[float]:
    """Exact weighted Jaccard similarity of the bags of a[i] and b[i]."""
    doc, element, weight, _ = bags([t for pair in zip(a, b, strict=True) for t in pair])
    pair = doc >> 1
    order = np.lexsort((element, pair))
    p, e, w = pair[order], element[order], weight[order]
    same = np.flatnonzero((p[1:] == p[:-1]) & (e[1:] == e[:-1]))
    total = np.bincount(p, w, len(a))
    shared = np.bincount(p[same], np.minimum(w[same], w[same + 1]), len(a))
    return (shared / np.maximum(total - shared, 1e-300)).tolist()


#: (id, t): the texts of what `need` (id) names, in a table of its own.
Texts = Callable[[DataFrame], DataFrame]


def looked_up(nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> Texts:
    """nodes: (n, id, th), the number, document and text hash of each distinct text."""

    def texts(need: DataFrame) -> DataFrame:
        places = cut(nodes.join(need.select(F.col("id").alias("n")), "n").select("n", "id", F.xxhash64("id").alias("k"), "th"), "places")
        rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull() & marked(F.col("id"), marks(places)))
        found = rows.select(F.xxhash64("id").alias("k"), F.xxhash64("t").alias("th"), "t")
        out = cut(found.groupBy("k", "th").agg(F.first("t").alias("t")).join(places, ["k", "th"]).select(F.col("n").alias("id"), "t"), "texts")
        discard(places)
        return out

    return texts


def verify(pairs: DataFrame, texts: Texts) -> DataFrame:
    """pairs (a, b) with their exact similarity, sim."""
    named = texts(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    both = pairs.join(named.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(named.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "ta", "tb", most_bytes=1 << 20):
            sim = similarity(part.column(2).to_pylist(), part.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    out = cut(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, sim double"), "verified")
    discard(named)
    return out


def link(active: DataFrame, texts: Texts, least: float) -> DataFrame | None:
    """(id, component) of what verified links join among the members of buckets (band, id)."""
    found = None

    def add(pairs: DataFrame) -> DataFrame:
        nonlocal found
        got = verify(pairs, texts)
        new = got.where(F.col("sim") >= least).select("a", "b")
        if found is None or not new.isEmpty():
            # Of earlier links their components' stars are enough.
            found = cut(components(new if found is None else found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(new)), "components")
        return got

    def meet(active: DataFrame) -> DataFrame:
        """Members of buckets of two or more, with the head: the one whose buckets hold the most, as a text does that the others are copies of."""
        sizes = active.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        met = cut(active.join(sizes, "band"), "met")
        scored = met.join(met.groupBy("id").agg(F.sum("n").alias("score")), "id")
        heads = scored.groupBy("band").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("head"))
        return met.join(heads, "band")

    def labelled(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.join(found.select(F.col("id").alias(col), F.col("component").alias(out)), col, "left").withColumn(out, F.coalesce(out, col))

    def apart(rows: DataFrame) -> DataFrame:
        """Whether a member isn't in its head's component by now."""
        return labelled(labelled(rows.drop("ci", "ch", "out"), "id", "ci"), "head", "ch").withColumn("out", F.col("ci") != F.col("ch"))

    met = cut(meet(active), "buckets")
    if met.isEmpty():
        return found
    add(met.where("id <> head").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct())
    rows = cut(apart(met), "rounds")
    for draw in range(DRAWS):
        # What fell out of a bucket is tried with one of those that stayed, in each bucket another.
        fell = rows.where("out and n > 2")
        if fell.isEmpty():
            break
        one = rows.where("not out").groupBy("band").agg(F.min_by("id", F.xxhash64("id", "band", F.lit(draw))).alias("x"))
        tries = fell.select("band", F.col("id").alias("y")).join(one, "band").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        add(cut(tries, "tries"))
        rows = cut(apart(rows), "rounds")
    fell = rows.where("out and n > 2").select("band", "id")
    if not fell.isEmpty():
        # In a bucket of two, both have been compared.
        beside = rows.join(fell.select("band").distinct(), "band", "left_semi").select("id").distinct()
        members = cut(beside.join(fell.select("id", F.lit(True).alias("fell")).distinct(), "id", "left"), "members")
        pairs = labelled(labelled(sharing(members, texts, least), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
        pairs = cut(pairs, "sharing")
        if not pairs.isEmpty():
            add(pairs)
        discard(members)
    discard(met)
    return found


def sharing(members: DataFrame, texts: Texts, least: float) -> DataFrame:
    """Pairs (a, b) of members (id, fell boolean), one or both of which fell, that can have a similarity of least: exact prefix filter.

    The shingles of all members are ordered from rare to common among them. Two bags that are that similar share one of the
    first shingles of each, as many as hold more than 1 - least of its weight. A text with much of its own has only
    shingles there that no other has, and so meets nobody. A shared shingle with too much weight before it, on either side, doesn't count.
    """
    named = texts(members.select("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "t", most_bytes=1 << 19):
            doc, element, weight, _ = bags(part.column(2).to_pylist())
            mass = np.bincount(doc, weight, part.num_rows).astype(np.int64)
            for i in range(0, len(doc), 1 << 16):
                d = doc[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), part.column(1).take(pa.array(d)), pa.array(element[i : i + (1 << 16)].view(np.int64)), pa.array(weight[i : i + (1 << 16)]), pa.array(mass[d])], ["id", "fell", "e", "w", "m"])

    rows = cut(named.join(members, "id").select("id", "fell", "t").mapInArrow(run, "id long, fell boolean, e long, w long, m long"), "shingles")
    ranked = rows.join(rows.groupBy("e").agg(F.count("*").alias("df")), "e")
    before = F.sum("w").over(Window.partitionBy("id", "m").orderBy("df", "e").rowsBetween(Window.unboundedPreceding, -1))
    prefix = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") <= (1 - least) * F.col("m") + 1e-9) & (F.col("df") > 1))
    prefix = cut(prefix.select("e", "id", "m", "before", F.coalesce("fell", F.lit(False)).alias("fell")), "prefixes")
    one, other = prefix.where("fell").select("e", F.col("id").alias("x"), F.col("m").alias("mx"), F.col("before").alias("bx")), prefix.select("e", F.col("id").alias("y"), F.col("m").alias("my"), F.col("before").alias("by"), "fell")
    # What can be shared from the first common shingle on must be enough; that of a pair to be found passes.
    fits = F.least(F.col("mx") - F.col("bx"), F.col("my") - F.col("by")) * (1 + least) >= least * (F.col("mx") + F.col("my")) - 1e-6
    pairs = one.join(other, "e").where(fits & (F.col("x") != F.col("y")) & (~F.col("fell") | (F.col("x") < F.col("y"))))
    out = cut(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near")
    discard(named, rows, prefix)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: id, th long (the text's hash), class_id (the least id of its class), kept boolean (it is the class's first by
    id and text hash)."""
    signed = cut(sign(docs, doc_id, text), "signed")
    some = signed.where("f1 is not null")
    first = lambda: F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th"))).alias("x")
    exact = some.groupBy("f1", "f2").agg(first())
    exact = cut(exact.select(F.monotonically_increasing_id().alias("n"), "f1", "f2", "x.id", "x.th"), "exact")
    heads = exact.select("n", F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("id").alias("i"), F.col("th").alias("h"))
    heads = some.join(heads, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    bands = cut(heads.select(F.col("n").alias("id"), F.explode("bands").alias("band")).distinct(), "bands")
    found = link(bands, looked_up(exact.select("n", "id", "th"), docs, doc_id, text), least)
    discard(bands)
    known = exact.withColumn("component", F.col("n"))
    if found is not None:
        known = exact.join(found.select(F.col("id").alias("n"), "component"), "n", "left").withColumn("component", F.coalesce("component", "n"))
    firsts = known.groupBy("component").agg(first())
    named = known.select("component", "f1", "f2").join(firsts, "component").select("f1", "f2", F.col("x.id").alias("class_id"), F.col("x.th").alias("class_th"))
    out = signed.select("id", "th", "f1", "f2").join(named, ["f1", "f2"], "left")
    alone = F.col("f1").isNull()
    kept = alone | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th")))
    return out.select("id", "th", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"))
