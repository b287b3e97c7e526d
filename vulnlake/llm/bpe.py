"""Byte-level BPE encoding and decoding by per-prefix dynamic programming.

Every prefix of a word has one last token in its BPE encoding.  An automaton over the vocabulary
gives, at every position, all tokens that end there (its suffix links list them longest first).
A token is the last one of a prefix if it stands next to the last token of the prefix before it,
that is, if no merge would ever cross their border: a test on the two tokens alone.  So each
position stores one token, and the back-pointers from the end of the word spell its ids, in time
linear in the word, however long it is.

The border test follows both tokens' merge trees.  A token's edge towards the border grows at the
ranks of its merges; two edge parts lie side by side between the later of their births and the
earlier of their next merges, and a merge of the two within that time would cross the border.
Equal ranks merge from the left.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import batch, grouped, rows

#: Words a worker remembers, twice that at most.
KEEP = 1 << 18
#: Pairs of tokens a worker remembers; beyond it, it starts anew.
KEEP_PAIRS = 1 << 19
#: Longer words are encoded each time.
KEEP_LENGTH = 64
NEVER = 1 << 60

CODES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.binary())])
CODES_SQL = "doc_id long, n_tokens long, ids string, decoded binary"
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGESTS_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


#: The letters, digits and white space of Latin-1, as the pattern of the byte-level BPE has them.
LETTERS, DIGITS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The same alternatives as the pattern's, words of letters first: no other one before it can begin as they do.
LATIN = re.compile("|".join(sorted(public_tokenizers.PATTERN.split("|"), key=lambda p: p != r" ?\p{L}+"))
                   .replace(r"[^\s\p{L}\p{N}]+", f"[^{SPACES}{LETTERS}{DIGITS}]++").replace(r"\p{L}+", f"[{LETTERS}]++")
                   .replace(r"\p{N}+", f"[{DIGITS}]++").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]"))
ANY = regex.compile(public_tokenizers.PATTERN)


def pre_words(text: str) -> list[str]:
    """The words into which a byte-level BPE splits a text before merging; Latin-1 texts by the
    standard library's faster engine."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ANY.findall(text)
    return LATIN.findall(text)


def letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes in order for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    out = {chr(b): b for b in plain}
    out.update((chr(256 + i), b) for i, b in enumerate(sorted(set(range(256)) - set(plain))))
    return out


class Known(dict):
    """Words with what ``encode`` makes of them.  At ``KEEP`` words they become the old ones, from
    which a word that is met again comes back, and the older ones are forgotten."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
            if len(word) > KEEP_LENGTH:
                return found
        if len(self) >= KEEP:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class ByteBPE:
    """A byte-level BPE from its tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte = letters()
        as_bytes = lambda token: bytes(byte[c] for c in token)
        ids = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        pre = spec.get("pre_tokenizer") or {}
        plain = (model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
                 and not model.get("end_of_word_suffix") and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                 and pre.get("use_regex", True) and not pre.get("add_prefix_space") and all(bytes([b]) in ids for b in range(256))
                 and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec.get("added_tokens") or []))
        if not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.bytes = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.born: dict[int, int] = {ids[bytes([b])]: -1 for b in range(256)}  # rank of the merge that makes a token
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}  # rank of each pair's merge
        for rank, pair in enumerate(model["merges"]):
            left, right = (as_bytes(p) for p in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, made = ids[left], ids[right], ids[left + right]
            if a not in self.born or b not in self.born or made in self.born:
                raise ValueError(f"merge {rank} of {path} uses a token that no earlier merge makes, or makes one again")
            self.merge[a, b], self.born[made], self.parts[made] = rank, rank, (a, b)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}  # by both tokens in one number
        self.words = Known(self.word)
        self.length = {t: len(self.bytes[t]) for t in self.born}
        self.ends = ahocorasick.Automaton()
        for t in self.born:
            if t not in self.parts or self.border(*self.parts[t], self.born[t]):  # else merges never end in it
                self.ends.add_word(self.bytes[t].decode("latin-1"), (self.length[t], t))
        self.ends.make_automaton()

    def border(self, a: int, b: int, until: int = NEVER) -> bool:
        """True if ``a`` and ``b`` stand side by side untouched by any merge before rank ``until``."""
        born, parts, merge = self.born, self.parts, self.merge.get
        grow_a = grow_b = until  # rank at which each edge part is merged into the next larger one
        born_a, born_b = born[a], born[b]
        while True:
            m = merge((a, b))
            if m is not None and m < grow_a and m <= grow_b and m < until:
                return False
            if born_a >= born_b:  # undo the younger one
                if born_a < 0:
                    return True
                grow_a, a = born_a, parts[a][1]
                born_a = born[a]
            else:
                grow_b, b = born_b, parts[b][0]
                born_b = born[b]

    def fits(self, a: int, b: int) -> bool:
        """``border``, remembered."""
        if len(self.pairs) >= KEEP_PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self.border(a, b)
        return known

    def word(self, text: str) -> list[int]:
        """Ids of one pre-tokenised word."""
        raw = text.encode().decode("latin-1")
        last = [-1] * (len(raw) + 1) if len(raw) < 1 << 16 else array("q", [-1]) * (len(raw) + 1)
        known = self.pairs.get
        for end, (size, token) in self.ends.iter(raw):
            end += 1
            if last[end] < 0:
                if size == end:
                    last[end] = token
                    continue
                before = last[end - size]
                fit = known(before << 32 | token)
                if fit is None:
                    fit = self.fits(before, token)
                if fit:
                    last[end] = token
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at -= self.length[out[-1]]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens' strings become their ids."""
        if self.split is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(self.words.__getitem__, pre_words(text))))
        out: list[int] = []
        for i, piece in enumerate(self.split.split(text)):
            out.extend([self.special[piece]] if i % 2 else chain.from_iterable(map(self.words.__getitem__, pre_words(piece))))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text's UTF-8 bytes; what is not UTF-8 becomes replacement characters."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """A worker's one copy for each file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def _mapped(docs: DataFrame, path: str, one, schema: pa.Schema, sql: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)

        def coded():
            for doc, text in rows(batches):
                ids = bpe.encode(text or "")
                yield doc, len(ids), *one(",".join(map(str, ids)), bpe.decode(ids))
        for group in grouped(coded(), lambda r: len(r[2]) + len(r[3]) + 64, 1 << 22):
            yield batch(schema, *zip(*group, strict=True))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, sql)


def codes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas), decoded (UTF-8) of every row of ``docs`` (doc_id, text).

    ``path``: a byte-level BPE in the tokenizers library's format; ids are those of its ``encode``
    without added special tokens, whose strings in a text stay special, and ``decoded`` is its
    ``decode`` with them kept.

    A null or empty text has no ids.  Every row is coded by itself: repeated rows are repeated, a
    null doc_id stays null, an empty table returns no rows, other columns are ignored.  A text
    of any length is encoded whole, in time in proportion to it."""
    return _mapped(docs, path or public_tokenizers.path("byte_bpe_50k.json"), lambda ids, text: (ids, text), CODES, CODES_SQL)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``codes`` with the SHA-256 of ids and decoded text instead of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    def hashed(ids: str, text: bytes) -> tuple[str, str]:
        return hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()
    return _mapped(docs, path or public_tokenizers.path("byte_bpe_50k.json"), hashed, DIGESTS, DIGESTS_SQL)
