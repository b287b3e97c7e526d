"""Benchmark decontamination by an FM-index over each shard of the training documents.

Windows of the benchmark items (``WINDOW`` consecutive words; a shorter item is one window) are
searched backward in the index of a shard, located through its sampled suffix positions and
merged to spans.  A shard is a run of documents of about ``SHARD`` bytes within one task,
so the work is one map over the documents: no shuffle, memory bounded by a shard.

A word outside the benchmark's vocabulary can be in no match.  The index therefore holds only
runs of vocabulary words that are as long as the shortest window at least; all others are
separators.  This loses nothing and keeps the index small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import grouped, map_rows, raw_text, rows
from vulnlake.llm.fm_index import FMIndex

WINDOW = 10
SHARD = 8 << 20
MOST_ITEMS = 200_000

#: A-Z to a-z; digits, a-z and bytes of 0x80 or more as they are; all else a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Numbers(dict):
    """Vocabulary: 0 for any word that is not in it."""

    def __missing__(self, word: bytes) -> int:
        return 0


@dataclass
class Phrases:
    """Windows of all items: ``patterns`` of word numbers, and the items that hold each."""

    vocabulary: Numbers
    patterns: list[np.ndarray]
    items: list[list[int]]

    @property
    def shortest(self) -> int:
        return min(map(len, self.patterns), default=0)


def phrases(benchmark: DataFrame, window: int = WINDOW, most: int = MOST_ITEMS) -> Phrases:
    """Windows of ``benchmark`` (item_id, text); a null or wordless text has none, rows without an
    id are left out.  The table may have at most ``most`` rows, which is checked."""
    found = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), raw_text().alias("text")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} benchmark items; search them in blocks")
    vocabulary, windows = Numbers(), {}
    for item, text in found:
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in bytes(text).translate(WORD_BYTES).split()]
        for i in range(max(1, len(words) - window + 1)) if words else ():
            windows.setdefault(tuple(words[i:i + window]), set()).add(item)
    keys = sorted(windows)
    return Phrases(vocabulary, [np.array(k, np.int64) for k in keys], [sorted(windows[k]) for k in keys])


def scan(texts: list[bytes], phrases: Phrases) -> list[tuple[int, int, list[int], list[tuple[int, int]]]]:
    """(words, hit words, items found, merged spans of hit words) of each text of one shard."""
    number = phrases.vocabulary.__getitem__
    ids = [np.fromiter(map(number, words), np.int64, len(words)) for words in (t.translate(WORD_BYTES).split() for t in texts)]
    size = np.array([len(x) for x in ids], np.int64)
    at = np.concatenate([[0], np.cumsum(size + 1)])  # a separator ends each text
    whole = np.zeros(int(at[-1]), np.int64)
    for a, x in zip(at, ids, strict=False):
        whole[a:a + len(x)] = x
    stops = np.flatnonzero(whole == 0)
    begins = np.concatenate([[0], stops[:-1] + 1])
    keep = stops - begins >= max(1, phrases.shortest)
    begins, length = begins[keep], (stops - begins)[keep] + 1
    out: list = [(int(n), 0, [], []) for n in size]
    if not len(begins) or not phrases.patterns:
        return out
    total = np.cumsum(length)
    origin = np.repeat(begins - (total - length), length) + np.arange(total[-1])
    index = FMIndex(whole[origin])
    lo, hi = index.search(phrases.patterns)
    which, place = index.locate(lo, hi)
    if not len(which):
        return out
    start = origin[place]
    stop = start + np.array([len(p) for p in phrases.patterns])[which]
    change = np.zeros(len(whole) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, stop, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)]))
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(at, opens, side="right") - 1
    pairs = np.unique(np.column_stack([np.searchsorted(at, start, side="right") - 1, which]), axis=0)
    items: dict[int, set[int]] = {}
    for d, w in pairs.tolist():
        items.setdefault(d, set()).update(phrases.items[w])
    for d in np.unique(doc).tolist():
        mine = doc == d
        spans = list(zip((opens[mine] - at[d]).tolist(), (closes[mine] - at[d]).tolist(), strict=True))
        out[d] = (int(size[d]), sum(b - a for a, b in spans), sorted(items[d]), spans)
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and what stands between them; one space joins what is left."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]].rstrip())
        at = places[b - 1][1]
    out.append(text[at:].lstrip(b".,;:!?") if spans else text[at:])
    return b" ".join(x for x in (p.strip(b" ") for p in out) if x)


FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
FOUND_SQL = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start: long, stop: long>>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), spans (of word numbers, merged) of every row of
    ``docs`` (doc_id, text).

    A null or wordless text has no words and no hits.  Repeated rows are each searched; ids may be
    null; a text longer than a shard is a shard of its own; with an empty benchmark nothing is
    hit, and without documents there are no rows; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases(benchmark, window))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(rows(batches), lambda r: len(r[1]) + 8, SHARD):
            n, hit, items, spans = zip(*scan([t for _, t in group], sent.value), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                ([d for d, _ in group], n, hit, items, [[{"start": a, "stop": b} for a, b in s] for s in spans]), FOUND.types, strict=True)], schema=FOUND)
    return docs.select(F.col("doc_id").cast("long"), raw_text().alias("text")).mapInArrow(work, FOUND_SQL)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text``; every row and column stays.

    Nulls, empty texts and texts without a hit are unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases(benchmark, window))
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).cast(pa.binary()).to_pylist()
            done: list[bytes | None] = []
            for group in grouped(iter(texts), lambda t: len(t or b"") + 8, SHARD):
                for t, (_, _, _, spans) in zip(group, scan([t or b"" for t in group], sent.value), strict=True):
                    done.append(cut(t, spans) if spans else t)
            columns = list(b.columns)
            columns[place] = pa.array(done, pa.binary()).cast(b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
    return map_rows(docs, work)
