"""Phrase collocations: candidates from a count-min sketch, exact counts by Aho-Corasick automata, then thresholds.

Texts become streams of words per language, with a mark between pieces (a byte that no UTF-8 text has), in blocks of about
a megabyte; a longer text is cut between words, and the last words of a block go along with the next, where matches that
lie wholly in them do not count again.

1. *Sketch.* Every task counts its phrases in two rows of one-byte counters that stop at 255, which only matters above the
   threshold; counters of all tasks are added slice by slice. A phrase occurs at most as often as either of its counters
   says. Words and pairs are counted first; a second sketch has only those phrases of 3 and 4 words whose words and pairs all
   may reach the threshold, so that rare ones do not fill it. Rows grow with the corpus, to at most 2 ** 27 counters: beyond
   that more phrases pass by chance, and are counted for nothing. One bit for each counter (at the threshold or not) is
   broadcast.
2. *Candidates* are the distinct words and phrases whose upper bound, and whose shorter parts' upper bounds, reach the
   threshold. A task finds those of a chunk of its texts, which ends once they have PATTERNS bytes or the texts CHUNK.
3. *Scan.* A chunk's candidates are compiled into an automaton, with a space at both ends of every pattern, so that matches
   are whole words in one piece, and the chunk is scanned by it; overlapping matches count. Whatever the number of
   candidates in all, texts are scanned once. A candidate is one in every chunk that has it, so chunks' counts are added.
4. *Thresholds* apply to the exact counts, so that neither sketch nor hashes can change a result.

Score of a phrase: for each cut into two parts, floor(scale a / (l + r)), the least of them, in 38-digit arithmetic.

Defined cases: a null text is empty; a null language is ``und``; empty texts, and texts without separators, have no
phrases but their words; null and repeated ids and repeated rows are texts of their own; an empty table, or one in which
nothing is frequent, gives no rows; other columns are ignored. Memory grows with the longest single word, not text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from operator import itemgetter
from types import SimpleNamespace

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, partitions, tidy, trim

BLOCK = 1 << 20
LONGEST = 4  # words of a phrase
PATTERNS = 5_000_000  # bytes of patterns that one automaton holds, but for those of one more block
CHUNK = 16 << 20  # bytes of texts that are scanned by one automaton
HELD = 1_000_000  # rows that a task adds up before it sends them
LONG = 1 << 16  # bytes of words that are hashed with others
MOST = 65536  # rows of a batch
PRUNED = 3  # words of the shortest phrases that are counted only if their parts may be frequent
SLICE = 14  # bits: counters that one row of the sketch's exchange holds
SALTS = 64
SPREAD = 2  # tasks of a pass over the texts, for each core
MARK = b"\xff"
# upper case to lower case, what ends a piece to the mark, and a tab to a space
_TABLE = bytes(32 + b if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def _words(raw: bytes) -> list[bytes]:
    return raw.replace(MARK, b" \xff ").split()


def _cut(texts: list[bytes]):
    """(carried words, bytes) of texts of one language: a text begins with a mark, and is cut only if longer than a block."""
    held, size = [], 0
    for text in texts:
        text = text.translate(_TABLE)
        if len(text) <= BLOCK:
            held.append(text)
            size += len(text) + 1
            if size >= BLOCK:
                yield [], MARK.join(held)
                held, size = [], 0
            continue
        begin, carried = 0, []
        while begin < len(text):
            end = begin + BLOCK
            if end < len(text):
                cut = max(text.rfind(MARK, begin, end), text.rfind(b" ", begin, end))
                if cut <= begin:  # one word longer than a block
                    cut = min((c for c in (text.find(MARK, end), text.find(b" ", end)) if c >= 0), default=len(text))
                end = cut
            yield carried, text[begin:end]
            carried, begin = (carried + _words(text[begin:end]))[1 - LONGEST :], end
    if held:
        yield [], MARK.join(held)


def blocks(texts: list[bytes]):
    """(carried words, words) of texts of one language."""
    return ((carried, _words(raw)) for carried, raw in _cut(texts))


def _streams(batches, cut=blocks):
    """(language, carried words, words) of batches of (language, text); or bytes, by ``_cut``."""
    for batch in batches:
        column = batch.column(0).dictionary_encode()
        own = column.indices.to_numpy()
        for k, lang in enumerate(column.dictionary.to_pylist()):
            texts = batch.column(1).take(pa.array(np.flatnonzero(own == k)))
            # Arrow keeps the texts; a block's worth becomes Python bytes at a time
            for carried, block in cut(t.as_buffer().to_pybytes() for t in texts):
                yield lang, carried, block


def _spans(raw: bytes):
    """Where the words of a block begin and end, and the number of marks before each."""
    each = np.frombuffer(raw, np.uint8)
    mark = each == MARK[0]
    edge = np.diff((~mark & (each != 32)).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin = np.flatnonzero(edge == 1)
    return begin, np.flatnonzero(edge == -1), np.searchsorted(np.flatnonzero(mark), begin)


# words' hashes are polynomials over 64 bits: a number for each byte, by the powers of an odd number, which has an inverse
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _hashes(raw: bytes, begin, end) -> np.ndarray:
    """The hash of each word, wherever it stands; words longer than LONG on their own, so that memory does not follow them."""
    out = np.empty(len(begin), np.uint64)
    long = np.flatnonzero(end - begin > LONG)
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[begin[k] : end[k]])
    for i, j in zip([0, *(long + 1).tolist()], [*long.tolist(), len(begin)]):
        if i < j:
            size, first, last = int(end[j - 1] - begin[i]), begin[i:j] - begin[i], end[i:j] - begin[i]
            if size > len(_powers[0]):
                _powers[:] = (np.multiply.accumulate(np.array([1, *[x] * size], np.uint64)) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTES[np.frombuffer(raw, np.uint8, size, begin[i])] * _powers[0][:size], out=total[1:])
            out[i:j] = (total[last] - total[first]) * _powers[1][first]
    return out


def _phrases(batches, shift: int):
    """(language, bytes, (carried words, words' begins, ends, pieces), {length: (first words' places, counters of both rows)}) of each block, carried phrases not again."""
    for lang, carried, raw in _streams(batches, _cut):
        raw = b" ".join([*carried, raw])
        old = len(carried) - carried.count(MARK)
        begin, end, piece = _spans(raw)
        hashes = _hashes(raw, begin, end)
        h, out = hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang)), {}
        for n in range(1, min(LONGEST, len(begin)) + 1):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(_ODD) + hashes[n - 1 :]
            first = max(0, old - n + 1)
            at = np.flatnonzero(piece[first : len(piece) - n + 1] == piece[first + n - 1 :]) + first
            mixed = h[at]
            for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(k)
            out[n] = at, ((mixed & np.uint64(0xFFFFFFFF)) >> np.uint64(shift)).astype(np.uint32), (mixed >> np.uint64(32 + shift)).astype(np.uint32)
        yield lang, raw, (old, begin, end, piece), out


def _may(found, size: int, heavy):
    """(length, places) of a block's phrases that may be frequent, as all their parts may; where ``heavy`` ends, only the parts say."""
    may = np.ones(size, bool)
    for n, (at, a, b) in found.items():
        # phrases wholly among carried words are not known here, and may be frequent
        now = np.zeros(size, bool)
        now[: at[0] if len(at) else 0] = True
        now[at] = True
        if n > 1:
            now[:-1] &= may[:-1] & may[1:]
        k = np.flatnonzero(now[at])
        for rows, place in zip(heavy[(n >= PRUNED) * 2 :][:2], (a, b)):
            k = k[(rows[place[k] >> 3] >> (7 - (place[k] & 7)) & 1).astype(bool)]
        now[at] = False
        now[at[k]] = True
        may = now
        yield n, k, at[k]


def _sketch(bits: int, shipped=None):
    """Slices (row and place, counters) of a task's sketch, those without a count left out: of the phrases below PRUNED words, or with their bits of the others."""

    def run(batches):
        count = np.zeros((2, 1 << bits), np.uint8)
        heavy = [np.frombuffer(raw, np.uint8) for raw in shipped.value] if shipped else []
        for _, _, (_, begin, *_), found in _phrases(batches, 32 - bits):
            if shipped:
                some = [tuple(row[k] for row in found[n][1:]) for n, k, _ in _may(found, len(begin), heavy) if n >= PRUNED]
            else:
                some = [f[1:] for n, f in found.items() if n < PRUNED]
            for row in (0, 1):
                place, n = np.unique(np.concatenate([np.empty(0, np.uint32), *(f[row] for f in some)]), return_counts=True)
                count[row, place] = np.minimum(255, count[row, place] + n)
        flat = count.reshape(-1, 1 << SLICE)
        used = np.flatnonzero(flat.any(axis=1))
        for s in range(0, len(used), 256):
            some = used[s : s + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pa.compress(flat[k].tobytes(), codec="zstd", asbytes=True) for k in some], pa.binary())], names=["slice", "counts"])

    return run


def _heavy(least: int):
    """Sorted by slice: one bit for each counter of a slice, whether its sum reaches ``least``."""

    def run(batches):
        own, total = None, None

        def bits():
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["slice", "heavy"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != own:
                    if own is not None:
                        yield bits()
                    own, total = k, np.zeros(1 << SLICE, np.int64)
                total += np.frombuffer(pa.decompress(raw.as_buffer(), 1 << SLICE, codec="zstd"), np.uint8)
        if own is not None:
            yield bits()

    return run


def _distinct(words: list[bytes], number, place, may) -> list[bytes]:
    """The phrases of a block, each once, that ``may`` be frequent; of what words there are at ``place``, with their numbers."""
    out, own = [], number
    for n, _, at in may[1:]:
        at = place[at]
        # a phrase is the number of the phrase without its last word, and that word's; what has none is like no other
        _, first, same = np.unique(own[at] << 32 | number[at + n - 1], return_index=True, return_inverse=True)
        own = np.arange(1 << 30, (1 << 30) + len(words))
        own[at] = same
        out += [b" ".join(words[i : i + n]) for i in at[first].tolist()]
    return out


def automaton(patterns: list[bytes]):
    """Finds each pattern between two spaces; its values are the patterns' numbers. Bytes are Latin-1 characters."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, pattern in enumerate(patterns):
        found.add_word(f" {pattern.decode('latin-1')} ", k)
    found.make_automaton()
    return found


def _rows(lang: str, phrases: list[bytes], n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _scan(shipped, most: int, total: bool):
    """(language, phrase, n), at most ``most`` a batch: matches of the patterns; with ``total`` the words of a language, as the empty phrase."""

    def run(batches, streams=_streams):
        patterns = shipped.value
        find, counts = automaton(patterns), {}

        def rows():
            for lang, count in counts.items():
                for s in range(0, len(count), most):
                    used = np.flatnonzero(count[s : s + most]) + s
                    yield _rows(lang, [patterns[k] if k < len(patterns) else b"" for k in used.tolist()], count[used])
            counts.clear()

        for lang, carried, words in streams(batches):
            if lang not in counts:
                if len(counts) >= 16:
                    yield from rows()
                counts[lang] = np.zeros(len(patterns) + 1, np.int64)
            text = b" ".join([b"", *carried, *words, b""]).decode("latin-1")
            before = sum(map(len, carried)) + len(carried)  # the place of the space after the carried words
            hits = find.iter(text) if patterns else ()
            picked = np.fromiter((v for e, v in hits if e > before), np.int64) if carried else np.fromiter(map(itemgetter(1), hits), np.int64)
            counts[lang] += np.bincount(picked, minlength=len(patterns) + 1)
            if total:
                counts[lang][-1] += len(words) - words.count(MARK)
        yield from rows()

    return run


def _chunks(shipped, bits: int, automaton_bytes: int):
    """(language, phrase, n) of a chunk: words that may be frequent, matches of its candidates, and all its words as the empty phrase.

    Phrases that are candidates in another language only may be too few, but those are below the threshold.
    """

    def run(batches):
        heavy = [np.frombuffer(raw, np.uint8) for raw in shipped.value]

        def fresh():
            return [], set(), defaultdict(count().__next__), {}, 0, automaton_bytes

        def scanned():
            """The rows of a chunk, whose automaton goes with them."""
            if size > BLOCK:
                trim()
            yield from _scan(SimpleNamespace(value=sorted(patterns)), MOST, False)(held, iter)
            names = list(numbers)
            for lang, (words, each) in totals.items():
                yield _rows(lang, [b""], [words])
                for s in range(0, len(each), MOST):
                    used = np.flatnonzero(each[s : s + MOST]) + s
                    yield _rows(lang, [names[k] for k in used.tolist()], each[used])

        def sent(rows, last=False):
            """Rows to go, and those to stay, equal phrases' added up."""
            if last or sum(r.num_rows for r in rows) >= HELD:
                table = pa.Table.from_batches(rows).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
                rows = table.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).to_batches(max_chunksize=MOST)
                if last or table.num_rows >= HELD * 2 // 3:
                    return rows, []
            return [], rows

        held, patterns, numbers, totals, size, room = fresh()
        rows = []
        for lang, raw, (old, begin, end, piece), found in _phrases(batches, 32 - bits):
            if room <= 0 or size >= CHUNK or lang not in totals and len(totals) >= 16:
                go, rows = sent([*rows, *scanned()])
                yield from go
                held, patterns, numbers, totals, size, room = fresh()
            may = list(_may(found, len(begin), heavy))
            # words that no frequent phrase can have are left out from here on
            some = np.zeros(len(begin), bool)
            some[:old] = True
            for _, _, at in may[:1]:
                some[at] = True
            place, some = np.cumsum(some) - 1, np.flatnonzero(some)
            number = np.fromiter(map(numbers.__getitem__, [raw[s:e] for s, e in zip(begin[some].tolist(), end[some].tolist())]), np.int64, len(some))
            names = list(numbers)
            words = [names[k] for k in number.tolist()]  # one object a word
            each = np.bincount(number[old:], minlength=len(names))
            before, seen = totals.get(lang, (0, each[:0]))
            each[: len(seen)] += seen
            totals[lang] = before + len(begin) - old, each
            more = set(_distinct(words, number, place, may)) - patterns
            patterns |= more
            room -= sum(map(len, more)) + 2 * len(more)
            # of these, the words of pairs are scanned, with a mark where others stood
            pair = np.zeros(len(begin), bool)
            pair[:old] = True
            for _, _, at in may[1:2]:
                pair[at] = pair[at + 1] = True
            pair = np.flatnonzero(pair)
            cut = np.flatnonzero((np.diff(pair) > 1) | (np.diff(piece[pair]) > 0)) + 1
            words.append(MARK)
            text = [words[k] for k in np.insert(place[pair], cut, -1).tolist()]
            own = old + int(np.searchsorted(cut, old))
            held.append((lang, text[:own], text[own:]))
            size += len(raw)
        if held:
            yield from sent([*rows, *scanned()], True)[0]

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _bits(bytes_: int) -> int:
    return min(27, max(16, (bytes_ // 32).bit_length()))


def reached(texts: DataFrame, least: int, bits: int, shipped=None) -> list[bytes]:
    """Bits of both rows of a sketch: whether a counter reaches ``least``; with the bits of the shorter phrases, those of the longer."""
    parts = texts.mapInArrow(tidy(_sketch(bits, shipped)), "slice int, counts binary")
    dealt = parts.repartition(partitions(texts.sparkSession), "slice").sortWithinPartitions("slice")
    # at most 2 ** 27 bits for each of two rows
    found = dealt.mapInArrow(_heavy(least), "slice int, heavy binary").collect()
    out = np.zeros((2 << bits >> SLICE, 1 << SLICE >> 3), np.uint8)
    for r in found:
        out[r.slice] = np.frombuffer(r.heavy, np.uint8)
    return [row.tobytes() for row in out.reshape(2, -1)]


def counts(docs: DataFrame, least: int = 30, automaton_bytes: int = PATTERNS) -> DataFrame:
    """(lang, phrase, n): exact counts of all words and phrases of 2 to 4 words that occur ``least`` times; and of all words, as the empty phrase."""
    if not 1 <= least <= 255:
        raise ValueError("counters hold 1 to 255")
    spark = docs.sparkSession
    context = spark.sparkContext
    # a task sends a whole sketch, and each candidate of a chunk once, so there are SPREAD tasks a core, not one a file
    texts = _texts(docs).coalesce(SPREAD * context.defaultParallelism)
    bits = _bits(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    short = reached(texts, least, bits)
    shipped = context.broadcast(short)
    both = context.broadcast(short + reached(texts, least, bits, shipped))
    shipped.unpersist()
    found = texts.mapInArrow(tidy(_chunks(both, bits, automaton_bytes)), "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return Scratch(spark, "phrases").keep(found.withColumn("phrase", F.col("phrase").cast("string")).filter((F.col("n") >= least) | (F.col("phrase") == "")))


def _inner(words: Column, n: Column) -> Column:
    """Phrases of at least two words, shorter than the phrase of ``n`` words, inside it."""
    whole = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    return F.explode(F.array_distinct(whole))


def scored(found: DataFrame, least: int = 30, scale: int = 2_000_000, share: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases in ``counts`` that occur ``least`` times, without those that a longer one covers."""
    all_words = found.filter("phrase = ''").select("lang", F.col("n").alias("n"))
    frequent = found.filter("phrase <> ''").withColumn("words", F.split("phrase", " ")).filter((F.size("words") > 1) & (F.col("n") >= least))
    frequent = frequent.select("lang", "phrase", "words", F.size("words").alias("len"), F.col("n").alias("a"))
    longer = frequent.filter("len > 2").select("lang", _inner(F.col("words"), F.col("len")).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = frequent.join(longer, ["lang", "phrase"], "left").filter(f"longer is null or cast(longer as decimal(38,0)) * 100 < cast(a as decimal(38,0)) * {share}")
    cuts = left.select("lang", "phrase", "a", "words", "len", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.col("len")), " ").alias("tail"))
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = found.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr(f"(cast(a as decimal(20,0)) * cast({scale} as decimal(10,0))) div (cast(l as decimal(20,0)) + r)").cast("long")
    best = cuts.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.join(all_words, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = 30, scale: int = 2_000_000, share: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, count and phrase."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored(counts(docs, least), least, scale, share).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # the first of every salt, so that no task ranks all phrases of a language
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for the rows of ``collocations``.
ORACLE = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
f AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM words, range(1, 5) t(k) WHERE len(w) >= k) GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE f >= 30 AND contains(phrase, ' ')),
inner_ AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) t(k), range(1, 4) u(i) WHERE k < len(w) AND i + k - 1 <= len(w) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ x USING (lang, phrase) WHERE x.longer IS NULL OR x.longer::HUGEINT * 100 < a::HUGEINT * 80),
cuts AS (SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * a // (h.f + t.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, len(w))) AS k FROM kept) c
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(w[1 : k], ' ') JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(w[k + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) QUALIFY rank <= 2000"""
