"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

Every source is a queue of tokens.  Time runs in quanta of ``QUANTUM`` tokens; each quantum
goes to the queue with the largest deficit (its target share of what has been placed, less
what it has been given), so every window holds the target proportions up to a quantum, and
what a queue lacks is carried into the next window.  A queue's i-th quantum is therefore due
at the time (2i+1) / (2 * weight), and its place in the whole order is the number of quanta
of all queues due earlier: a closed form over the queues' totals.  Each task computes the
places of its own tokens with no state of other tasks, and deficits carry across windows and
partitions exactly.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.bpe import LATIN, Known, letters
from vulnlake.llm.common import batch, grouped, rows, stage_table

QUANTUM = 64
SPACE = chr(256 + 32)  # of a byte-level vocabulary
MOST_SOURCES = 10_000
#: Rows (queue, task) of the table of queue starts that may be broadcast: some 10 MB.
MOST_BROADCAST = 200_000

TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int64()), ("at", pa.int64()),
                    ("n", pa.int64()), ("ids", pa.binary())])
TOKENS_SQL = "doc_id long, source string, part long, at long, n long, ids binary"
PIECES = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_SQL = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a byte-level BPE by the tokenizers library, as bytes.  The library's model works word by
    word, so each word is given to it once and remembered.  Texts beyond Latin-1, and texts with
    a special token's string, are given to the library whole."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, {b: c for c, b in letters().items()}
        self.words = Known(self.word)

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.kind == "<u2" else "I", ids).tobytes()

    def word(self, text: str) -> bytes:
        if text.isascii() and text.isprintable():  # stand for themselves, but for the space
            text = text.replace(" ", SPACE)
        else:
            text = text.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(text)])

    def __call__(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            whole = any(s in text for s in self.special)
        except UnicodeEncodeError:
            whole = True
        if whole:
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, LATIN.findall(text)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """A worker's one encoder for each file."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def id_type(path: str, end_id: int) -> str:
    """Smallest unsigned type that holds every id; the tokens are staged in it."""
    from tokenizers import Tokenizer
    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, source, part, at, n, ids) of every row: ids in ``id_type``, with ``end_id`` last;
    ``at`` is the row's place in its task's queue of that source."""
    kind = id_type(path, end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, upto = encoder(path, kind), TaskContext.get().partitionId(), {}
        end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        def one(row):
            doc, source, text = row
            ids = encode(text or "") + end
            at = upto.get(source, 0)
            upto[source] = at + len(ids) // width
            return doc, source, part, at, len(ids) // width, ids
        for group in grouped(map(one, rows(batches)), lambda r: len(r[-1]) + 64, 1 << 22):
            yield batch(TOKENS, *zip(*group, strict=True))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), source.alias("source"), "text").mapInArrow(work, TOKENS_SQL)


def whole_weights(totals: dict[str, int], targets: dict[str, float] | None) -> dict[str, int]:
    """Integer weights of the sources: the targets, or else the token counts themselves.  A source
    that ``targets`` lacks or gives 0 gets the smallest weight of all over its token count."""
    if targets is None:
        return {s: max(1, n) for s, n in totals.items()}
    wanted = {s: Fraction(targets.get(s, 0)).limit_denominator(10_000) for s in totals}
    least = min([w for w in wanted.values() if w > 0], default=Fraction(1)) / 10_000
    wanted = {s: w if w > 0 else least for s, w in wanted.items()}
    whole = lcm(*[w.denominator for w in wanted.values()])
    return {s: int(w * whole) for s, w in wanted.items()}


class Schedule:
    """Places of queue tokens in the one packed order.  ``totals``: tokens by source."""

    def __init__(self, totals: dict[str, int], weights: dict[str, int], quantum: int):
        self.names = sorted(totals)
        self.quantum = quantum
        self.weight = [weights[s] for s in self.names]
        self.quanta = [-(-totals[s] // quantum) for s in self.names]
        self.short = [q * quantum - totals[s] for q, s in zip(self.quanta, self.names, strict=True)]  # missing from each last quantum
        self.index = {s: i for i, s in enumerate(self.names)}
        self.safe = 2 * (max(self.quanta, default=1) + 1) * max(self.weight, default=1) < 2**62

    def places(self, source: str, quanta: np.ndarray) -> np.ndarray:
        """First token's place of some quanta of a source."""
        s = self.index[source]
        due = 2 * quanta.astype(np.int64 if self.safe else object) + 1
        out = due * 0
        for o, (w, n, short) in enumerate(zip(self.weight, self.quanta, self.short, strict=True)):
            ahead = (due * w - (0 if o < s else 1)) // self.weight[s]  # earlier: by time, ties by source
            count = np.minimum((ahead + 1) // 2, n)
            out += count * self.quantum - np.where(count == n, short, 0) if o != s else (due - 1) // 2 * self.quantum
        return out.astype(np.int64)


def cut(place: Schedule, source: str, start: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents that lie at ``start .. start+n`` of their source's queue, in order: document
    (its position), start in it, length, place; neighbours that stay together are one piece."""
    def fan(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and step of each of ``size`` steps of every row."""
        row = np.repeat(np.arange(len(size)), size)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    q = place.quantum
    doc, step = fan((start + n - 1) // q - start // q + 1)
    quantum = (start // q)[doc] + step
    lo, hi = np.maximum(start[doc], quantum * q), np.minimum((start + n)[doc], (quantum + 1) * q)
    at = place.places(source, quantum) + lo - quantum * q
    row, step = fan((at + hi - lo - 1) // window - at // window + 1)  # cut at the windows' ends
    first = np.maximum(at[row], (at[row] // window + step) * window)
    last = np.minimum((at + hi - lo)[row], (at[row] // window + step + 1) * window)
    doc, lo, length = doc[row], (lo - start[doc])[row] + first - at[row], last - first
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != last[:-1]) | (first[1:] % window == 0)
    head = np.flatnonzero(new)
    return doc[head], lo[head], np.add.reduceat(length, head) if len(head) else length, first[head]


def pack(docs: DataFrame, window: int = 1024, targets: dict[str, float] | None = None, quantum: int = QUANTUM,
         path: str | None = None, end_id: int = 0, most_sources: int = MOST_SOURCES) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, source, text) into sequences of ``window`` tokens.

    Returns one row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.  ``targets``: wanted token share by source; a queue that runs dry leaves its share to
    the others, so that every token is placed.  Without targets the corpus's own shares are kept.
    All sequences but the last are full.

    A null or empty text is one end token; a null source is the queue ''; repeated rows are packed
    again; a null doc_id stays null; an empty table gives no pieces; other columns are ignored.  A
    document of any length is cut, never shortened.  The queues' totals (one row a source, at most
    ``most_sources``, which is checked) are all that the driver gets."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    tokens = stage_table(tokenize(docs, path, end_id), "tokens")
    by_part = stage_table(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "queues")
    found = by_part.groupBy("source").agg(F.sum("n").alias("n")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources; map them to fewer queues first")
    totals = {r["source"]: r["n"] for r in found}
    kind = id_type(path, end_id)
    place = Schedule(totals, whole_weights(totals, targets), quantum)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if by_part.count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)  # a row a queue and task; beyond the bound Spark joins by shuffle

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(rows(batches), lambda r: len(r[4]) + 64, 1 << 22):
            by_source: dict[str, list[tuple]] = {}
            for r in group:
                by_source.setdefault(r[1], []).append(r)
            for source, mine in by_source.items():
                n = np.array([r[3] for r in mine])
                doc, lo, length, at = cut(place, source, np.array([r[2] for r in mine]), n, window)
                ids = memoryview(np.frombuffer(b"".join(r[4] for r in mine), kind).astype("<u4").tobytes())
                from_ = 4 * ((np.cumsum(n) - n)[doc] + lo)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(from_.tolist(), (from_ + 4 * length).tolist(), strict=True)]
                own = pa.array([r[0] for r in mine], pa.int64()).take(pa.array(doc))
                columns = [own, pa.repeat(source, len(doc)), *(pa.array(x, pa.int64()) for x in (lo, length, crc, n[doc], at // window, at % window))]
                yield pa.RecordBatch.from_arrays(columns, schema=PIECES)
    at = tokens.join(starts, ["source", "part"]).select("doc_id", "source", (F.col("base") + F.col("at")).alias("start"), "n", "ids")
    return at.mapInArrow(work, PIECES_SQL)
