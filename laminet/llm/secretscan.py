"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Base spans come from three patterns. The method adds spans of kind `random`: runs of LEAST or more characters of
ALPHABET, clear of all base spans, whose log-likelihood ratio between an order-1 character model of random strings and
one of ordinary identifiers is MARGIN nats or more a character; of other such runs, the stretches of LEAST or more
characters between separators (what isn't a letter or digit) for which it is. The models are trained from labelled samples
(text, is_secret): those given, or those that `samples` makes from a bounded part of the documents, where what base
spans hold is labelled secret and all other runs ordinary, with seeded random strings besides.

Cases: a null text has no spans, like an empty one; spans are code points, end exclusive; repeated rows give each their
own; an empty table gives an empty one; without ordinary samples the ratio is taken against uniform characters.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import string
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminet.llm.common import own_name, pieces, with_fields

# The base patterns, with the least length of their last group (or of the match) and the order of kinds.
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more are the matches of [0-9a-f]+ that are long enough
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
LEAST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
PIECE = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
#: Nats a character by which a run must be likelier as a random string.
MARGIN = 0.75
SAMPLE_DOCS = 400
SAMPLE_RUNS = 20_000
SYNTHETIC = 2_000

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


class Cover:
    """What spans, sorted by start, cover, as separate stretches: overlaps are told by one search each."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e, _ in spans:
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Labelled samples of secrets: characters drawn evenly from the alphabets that keys are written in."""
    rng = random.Random(seed)
    sets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.hexdigits[:16]]
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(20, 48))) for i in range(n)]


def ordinary_strings(n: int, seed: int = 11) -> list[str]:
    """Labelled samples of ordinary identifiers: numbers drawn evenly, of one digit or counting up, timestamps, and UUIDs."""
    rng, digits, out = random.Random(seed), string.digits, []
    for i in range(n):
        k, at = rng.randint(8, 28), rng.randrange(10)
        stamp = f"{rng.randint(1990, 2040)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}{rng.randint(0, 23):02}{rng.randint(0, 59):02}{rng.randint(0, 59):02}" + "0" * rng.randint(0, 6)
        kinds = ("".join(rng.choices(digits, k=k)), digits[at] * k, (digits * 4)[at : at + k], stamp, str(uuid.UUID(int=rng.getrandbits(128), version=4)))
        out.append(kinds[i % len(kinds)])
    return out


class Markov:
    """Log-likelihood ratio of order-1 character models, add-one smoothed: a table by (character before, character)."""

    def __init__(self, secret: Iterable[str], ordinary: Iterable[str]):
        n = len(ALPHABET)
        self.code = {c: i for i, c in enumerate(ALPHABET)}
        tables = []
        for texts in (secret, ordinary):
            counts = [[1.0] * n for _ in range(n + 1)]  # the last row: at the start
            for t in texts:
                before = n
                for c in t:
                    if (i := self.code.get(c)) is not None:
                        counts[before][i] += 1
                        before = i
            tables.append([[math.log(x / sum(row)) for x in row] for row in counts])
        self.ratio = {(a, b): x - y for a, *rows in zip([*ALPHABET, ""], *tables, strict=True) for b, x, y in zip(ALPHABET, *rows, strict=True)}

    def score(self, run: str) -> float:
        """Nats a character in favour of a random string."""
        ratio = self.ratio
        return (ratio["", run[0]] + sum(map(ratio.__getitem__, zip(run, run[1:], strict=False)))) / len(run)

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the whole run if it scores MARGIN or more, else of the stretches that do, from a piece's start to a piece's end:
        the one with most nats beyond MARGIN, up to where no stretch does, then on behind it."""
        if self.score(run) >= MARGIN:
            return [(0, len(run))]
        pieces = [m.span() for m in PIECE.finditer(run)]
        if not pieces or pieces[0] == (0, len(run)):
            return []
        ratio, out, k = self.ratio, [], 0
        total = [0.0, *itertools.accumulate(ratio[x] - MARGIN for x in zip(["", *run], run, strict=False))]
        before = {s: total[s + 1] - (ratio["", run[s]] - MARGIN) for s, _ in pieces}
        while k < len(pieces):
            best, low, at, w = None, math.inf, 0, k
            for x in range(k, len(pieces)):
                end = pieces[x][1]
                while w <= x and pieces[w][0] <= end - LEAST:
                    if before[pieces[w][0]] < low:
                        at = pieces[w][0]
                        low = before[at]
                    w += 1
                beyond = total[end] - low
                if beyond >= 0 and (best is None or beyond > best[0]):
                    best = (beyond, at, x)
                elif best is not None and beyond < 0:
                    break
            if best is None:
                break
            out.append((best[1], pieces[best[2]][1]))
            k = best[2] + 1
        return out


def samples(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> list[tuple[str, bool]]:
    """At most SAMPLE_RUNS labelled runs of the SAMPLE_DOCS documents with the lowest hashes, and SYNTHETIC made strings of each label."""
    out: list[tuple[str, bool]] = []
    rows = docs.select(F.col(text), F.xxhash64(doc_id, text).alias("h")).where(F.col(text).isNotNull())
    # By the number of documents, a share in which the lowest hashes are likely enough found: no more is sorted.
    share = min(1.0, (2 * SAMPLE_DOCS + 100) / max(1, docs.count()))
    for (t,) in rows.where((F.col("h") / F.lit(2.0**64) + 0.5) <= share).orderBy("h").limit(SAMPLE_DOCS).select(text).toLocalIterator():
        held = Cover(base_spans(t))
        for m in WORD.finditer(t):
            out.append((m.group(), held.meets(m.start(), m.end())))
        if len(out) >= SAMPLE_RUNS:
            break
    return out[:SAMPLE_RUNS] + [(t, True) for t in random_strings(SYNTHETIC)] + [(t, False) for t in ordinary_strings(SYNTHETIC)]


def train(labelled: Iterable[tuple[str, bool]]) -> Markov:
    """Of what is labelled secret, only runs of LEAST characters or more tell of random strings (keywords and short values don't).
    Ordinary runs without digits count in capitals too: these are rare in texts, and hardly seen contexts would be near uniform in both models."""
    labelled = list(labelled)
    ordinary = [t for t, secret in labelled if not secret]
    return Markov([t for t, secret in labelled if secret and len(t) >= LEAST], [*ordinary, *(u for t in ordinary if (u := t.upper()) != t and not any(map(str.isdigit, t)))])


def scan_text(text: str, model: Markov) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the models add."""
    base = base_spans(text)
    held = Cover(base)
    added = [(m.start() + a, m.start() + b, 3) for m in RUN.finditer(text) if not held.meets(m.start(), m.end()) for a, b in model.stretches(m.group())]
    return base, added


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, model: Markov, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds base and added, both array<struct<kind string, start int, end int>>; keep: the columns to carry, the text not
    needed among them (all if None)."""
    names = [own_name(docs, n) for n in ("base", "added")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    carried = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in pieces(batches, text):
            found = [scan_text(t or "", m) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            new = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in x[j]] for x in found], kind) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in carried), *new], [*carried, *names])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(*dict.fromkeys([*carried, text])).mapInArrow(run, with_fields(docs.select(*carried), *((n, spans) for n in names)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
