"""Packing token sequences of a fixed length by the sum-of-squares rule, online.

A document (its ids and a closing id) gives full windows first; the rest, shorter than a window, is placed at once. Partly
filled windows are counted by fill level in an array N, and a rest of s tokens goes to the level h (0: a new window) for
which the sum of N^2 is least once a window has moved from h to h + s; of equals the fullest counts. Like levels therefore
never pile up while others could take the document, and most documents stay whole.

At most ``most_open`` windows are open: beyond that, the emptiest are taken apart and their documents cut to fill the
fullest exactly, until half are left. A task ends in the same way, down to one window, whose tokens leave as windows of
powers of two, which need no padding. Every task packs the rows that it reads, so nothing is exchanged, memory is
bounded by the open windows, and a lost task is made again from its rows alone.

Ids are the tokenizers library's. Texts are cut into words where the pattern's matches end for certain (``_starts``), the
distinct cuts of a few megabytes are encoded by the library, and their ids are remembered (at most 2 x MEMO of them). The
vocabulary must be byte-level with this pattern. Strings of special tokens in a text are ordinary text.

Defined cases: a null text is empty; an empty text has the closing id alone; null and repeated ids and repeated rows are
documents of their own; texts of any length give windows as they come; an empty table gives no rows; other columns are
ignored whatever their names are.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import tidy

MEMO = 400_000
SLICE = 2 << 20  # bytes of text worked on at a time
_PLAIN = re.compile(rb" ?[^\s\x1c-\x1f\x80-\xff]+|[\xc3][\x80-\xbf]").fullmatch
_LAST, _NEXT = re.compile(rb"[!-~](?= [!-~])"), 4096


def _starts(raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a cut: whatever stands before and after, the pattern's matches end there, and each side's are its own.

    That holds before a space between two characters; between a letter or digit and one of .,;:!? on either side; and
    around a single end of line between two characters. Characters are printable ASCII, or Latin letters of two bytes
    beginning with C3; next to others nothing is cut.
    """
    at = lambda k: np.concatenate([np.zeros(max(0, -k), np.uint8), raw[max(0, k) : len(raw) + min(0, k)], np.zeros(max(0, k), np.uint8)])[: len(raw)]
    two, one, after = at(-2), at(-1), at(1)
    latin = (one >= 0x80) & (two == 0xC3)
    behind, here, ahead = _KIND[one], _KIND[raw], _KIND[after]
    is_character = (behind > 0) | latin
    stop = (here == 2) & ((behind == 3) | latin & (one != 0x97) & (one != 0xB7)) | (here == 3) & (behind == 2)
    break_ = is_character & ((ahead > 0) | (after == 0xC3)) & ((raw == 0x20) | (raw == 0x0A))
    return stop | break_ | np.concatenate([[False], (break_ & (raw == 0x0A))[:-1]])


# printable ASCII: 3 letters and digits, 2 stops, 1 others
_KIND = np.array([0 if not 0x21 <= b <= 0x7E else 3 if chr(b).isalnum() else 2 if chr(b) in ".,;:!?" else 1 for b in range(256)], np.uint8)


def _blocks(text: bytes):
    """A text in pieces of about SLICE bytes, cut where ``_starts`` cuts."""
    begin = 0
    while len(text) - begin > SLICE:
        end = begin + SLICE
        found = [m.end() for m in _LAST.finditer(text, end - _NEXT, end)] or [m.end() for m in [_LAST.search(text, end)] if m]
        if not found:
            break
        yield text[begin : found[-1]]
        begin = found[-1]
    yield text[begin:]


class Ids:
    """Packed ids (little-endian, 32 bits) of texts, by a byte-level tokenizer of the tokenizers library."""

    def __init__(self, definition: str, memo: int = MEMO):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        self.real = tokenizers.Tokenizer.from_str(definition)
        self.real.encode_special_tokens = True
        self.memo, self.young, self.old = memo, {}, {}
        line = self.real.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def _learn(self, cuts: list[bytes]) -> None:
        """Remembers the ids of new cuts: those without inner space in one text of many lines, as a line's end is a token of
        its own between two of them; others one by one."""
        plain = [c for c in cuts if _PLAIN(c)] if self.line is not None else []
        for s in range(0, len(plain), 2000):
            some = plain[s : s + 2000]
            (found,) = self.real.encode_batch_fast([b"\n".join(some).decode()], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            at = [-1, *np.flatnonzero(ids == self.line).tolist(), len(ids)]
            if len(at) == len(some) + 1:
                raw = ids.tobytes()
                self.young.update((c, raw[4 * a + 4 : 4 * b]) for c, a, b in zip(some, at, at[1:]))
        rest = [c for c in cuts if c not in self.young]
        for s in range(0, len(rest), 4096):
            for c, found in zip(rest[s : s + 4096], self.real.encode_batch_fast([c.decode() for c in rest[s : s + 4096]], add_special_tokens=False)):
                self.young[c] = np.array(found.ids, "<u4").tobytes()

    def _known(self, every: list[bytes]) -> list[bytes]:
        fresh = [c for c in every if c not in self.young]
        if len(self.young) + len(fresh) > self.memo:
            self.young, self.old, fresh = {}, self.young, every
        unknown = []
        for c in fresh:
            if c in self.old:
                self.young[c] = self.old[c]
            else:
                unknown.append(c)
        self._learn(unknown)
        return [self.young[c] for c in every]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts, given as UTF-8; long ones in blocks."""
        out, held, size = [], [], 0
        for text in texts:
            if len(text) > SLICE:
                out += self._encode(held)
                out.append(b"".join(self._encode([block])[0] for block in _blocks(text)))
                held, size = [], 0
                continue
            held.append(text)
            size += len(text)
            if size > SLICE:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.array([len(t) for t in texts], np.int64)
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        raw, ends = np.frombuffer(data, np.uint8), np.cumsum(sizes)
        begins = _starts(raw)
        begins[(ends - sizes)[sizes > 0]] = True
        cut = np.flatnonzero(begins)
        offsets = np.append(cut, len(raw)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        known = self._known(found.dictionary.to_pylist())
        flat, n = np.frombuffer(b"".join(known), "<u4"), np.array([len(k) // 4 for k in known], np.int64)
        own = found.indices.to_numpy()
        lengths = n[own]
        upto = np.cumsum(lengths)
        ids = flat[np.repeat((np.cumsum(n) - n)[own] - (upto - lengths), lengths) + np.arange(upto[-1])].tobytes()
        # ids before each text: those of the cuts that begin before it
        marks = np.concatenate([[0], upto])[np.searchsorted(cut, np.append(ends - sizes, len(raw)))] * 4
        marks = marks.tolist()
        return [ids[a:b] for a, b in zip(marks, marks[1:])]


class Levels:
    """The level array: how many windows are filled to each level, and where a rest should go."""

    def __init__(self, length: int):
        self.length, self.never = length, 1 << 60
        self.count = np.zeros(length + 1, np.int64)
        # what taking a window from a level, and putting one to it, adds to the sum of squares
        self.taken, self.put = np.full(length + 1, self.never), np.ones(length + 1, np.int64)
        self.taken[0] = self.put[length] = 0

    def add(self, level: int, n: int) -> None:
        if 0 < level < self.length:
            self.count[level] += n
            self.taken[level] = 1 - 2 * self.count[level] if self.count[level] else self.never
            self.put[level] = 1 + 2 * self.count[level]

    def choose(self, size: int) -> int:
        """The level from which the sum of squares grows least; the fullest of equals."""
        last = self.length - size
        return last - int((self.taken[: last + 1] + self.put[size:])[::-1].argmin())


class Packer:
    """Windows of one task; ``done`` is called with (window number, pieces) of each that is finished.

    A piece is (row, start, bytes of its ids).
    """

    def __init__(self, length: int, most_open: int, done):
        self.length, self.most_open, self.done = length, most_open, done
        self.levels, self.open, self.n_open, self.windows = Levels(length), [[] for _ in range(length)], 0, 0

    def _close(self, pieces: list) -> None:
        self.done(self.windows, pieces)
        self.windows += 1

    def add(self, row, ids: bytes) -> None:
        whole = 4 * self.length
        full = len(ids) // whole * whole
        for s in range(0, full, whole):
            self._close([(row, s // 4, ids[s : s + whole])])
        size = (len(ids) - full) // 4
        if not size:
            return
        level = self.levels.choose(size)
        window = self.open[level].pop() if level else []
        self.n_open += not level
        self.levels.add(level, -1)
        window.append((row, full // 4, ids[full:]))
        self._keep(window, level + size)
        if self.n_open > self.most_open:
            self._merge(self.most_open // 2)

    def _keep(self, window: list, level: int) -> None:
        if level == self.length:
            self.n_open -= 1
            self._close(window)
        else:
            self.levels.add(level, 1)
            self.open[level].append(window)

    def _merge(self, left: int) -> None:
        """Fills the fullest windows with cuts of the emptiest until ``left`` are open."""
        rows = [(level, window) for level in range(1, self.length) for window in self.open[level]]
        self.open, self.levels, self.n_open = [[] for _ in range(self.length)], Levels(self.length), len(rows)
        low, high = 0, len(rows) - 1
        while high - low + 1 > left and low < high:
            fill, window = rows[high]
            have, from_ = rows[low]
            row, start, ids = from_.pop()
            size = min(len(ids) // 4, self.length - fill)
            keep = len(ids) // 4 - size
            window.append((row, start + keep, ids[4 * keep :]))
            if keep:
                from_.append((row, start, ids[: 4 * keep]))
            rows[low], rows[high] = (have - size, from_), (fill + size, window)
            if have == size:
                low += 1
                self.n_open -= 1
            if fill + size == self.length:
                high -= 1
                self.n_open -= 1
                self._close(window)
        for level, window in rows[low : high + 1]:
            self.levels.add(level, 1)
            self.open[level].append(window)

    def finish(self) -> None:
        self._merge(1)
        for level in range(self.length):
            for window in self.open[level]:
                for bit in reversed(range(level.bit_length())):
                    if level >> bit & 1:
                        self._close(_take(window, 1 << bit))
        self.open, self.levels, self.n_open = [[] for _ in range(self.length)], Levels(self.length), 0


def _take(window: list, size: int) -> list:
    """The last ``size`` tokens of a window's pieces, cut off from it."""
    out = []
    while size:
        row, start, ids = window.pop()
        keep = max(0, len(ids) // 4 - size)
        if keep:
            window.append((row, start, ids[: 4 * keep]))
        out.append((row, start + keep, ids[4 * keep :]))
        size -= len(ids) // 4 - keep
    return out


_readers: dict[int, Ids] = {}


def _reader(shipped, memo: int) -> Ids:
    key = hash((shipped.value, memo))
    if key not in _readers:
        _readers.clear()
        _readers[key] = Ids(shipped.value, memo)
    return _readers[key]


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = 1024, end: int = 0, path: str | None = None, most_open: int = 2048, ids: bool = False, memo: int = MEMO) -> DataFrame:
    """One row for each piece of a document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's; ``doc_tokens`` has the closing id
    ``end``; ``ids`` adds the piece's ids.
    """
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary, whatever the size of the data
    closing = np.array([end], "<u4").tobytes()

    def run(batches):
        reader, base, out = _reader(shipped, memo), TaskContext.get().partitionId() << 40, []

        def done(window, pieces):
            at = 0
            for (doc, total), start, raw in pieces:
                out.append((doc, start, len(raw) // 4, zlib.crc32(raw), total, base + window, at, raw))
                at += len(raw) // 4

        def rows():
            columns = list(zip(*out)) if out else [()] * 8
            made = [pa.array(c, pa.int64()) for c in columns[:7]]
            if ids:
                made.append(pa.array([np.frombuffer(raw, "<i4") for raw in columns[7]], pa.list_(pa.int32())))
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=[part.split()[0] for part in _SCHEMA.split(", ")] + ["ids"] * ids)

        packer = Packer(length, most_open, done)
        for batch in batches:
            for s in range(0, len(batch), 500):
                some = batch.slice(s, 500)
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in some.column(1)]
                for doc, raw in zip(some.column(0).to_pylist(), reader.encode(texts)):
                    packer.add((doc, len(raw) // 4 + 1), raw + closing)
                yield rows()
        packer.finish()
        yield rows()

    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut.mapInArrow(tidy(run), _SCHEMA + ", ids array<int>" * ids)


def sequences(packed: DataFrame, length: int = 1024, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, n_ids) of ``pack(..., ids=True)``: each sequence in order, padded unless its length is a power of two."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most ``length`` pieces
    whole = parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
    n = F.size("ids")
    padded = F.concat("ids", F.array_repeat(F.lit(pad), F.when(F.bit_count(n) == 1, 0).otherwise(F.lit(length) - n)))
    return whole.select("sequence_id", padded.alias("ids"), n.alias("n_ids"))
