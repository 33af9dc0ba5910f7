"""SQL that DuckDB runs over the same tables, for the queries whose rows it can give."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_MASK = (1 << 64) - 1
# fixed values: the primes of XXH64
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _int(v: int) -> str:
    return f"{v}::UHUGEINT"


def _mul(a: str, p: int) -> str:
    return f"(({a}) * {_int(p)} & {_int(_MASK)})"


def _add(a: str, b: str) -> str:
    return f"(({a}) + ({b}) & {_int(_MASK)})"


def _rotl(x: str, r: int) -> str:
    return f"((({x}) * {_int(1 << r)} & {_int(_MASK)}) + ({x}) // {_int(1 << (64 - r))})"


def _round(acc: str, lane: str) -> str:
    return _mul(_rotl(_add(acc, _mul(lane, _P2)), 31), _P1)


def _lane(at: str, n: int = 8) -> str:
    return "(" + " + ".join(f"b[{at} + {k + 1}]::UHUGEINT * {_int(1 << (8 * k))}" for k in range(n)) + ")"


def _fold(x: str, r: int) -> str:
    return f"xor({x}, ({x}) // {_int(1 << r)})"


def xxh64(source: str, seed: int = 42) -> str:
    """Common table expressions (recursive ones) that end in hashed(s, h): XXH64 of every string of the table ``source`` (s)."""
    start = [(seed + _P1 + _P2) & _MASK, (seed + _P2) & _MASK, seed, (seed - _P1) & _MASK]
    opened = _add(_add(_rotl("v1", 1), _rotl("v2", 7)), _add(_rotl("v3", 12), _rotl("v4", 18)))
    merged = ""
    for k in range(1, 5):
        step = _add(_mul(f"xor(h, {_round(_int(0), f'v{k}')})", _P1), _int(_P4))
        merged += f"merged{k} AS (SELECT * REPLACE (CASE WHEN n >= 32 THEN {step} ELSE h END AS h) FROM {f'merged{k - 1}' if k > 1 else 'opened'}),\n"
    eight = _add(_mul(_rotl(f"xor(h, {_round(_int(0), _lane('pos'))})", 27), _P1), _int(_P4))
    four = _add(_mul(_rotl(f"xor(h, {_mul(_lane('pos', 4), _P1)})", 23), _P2), _int(_P3))
    one = _mul(_rotl(f"xor(h, {_mul('b[pos + 1]::UHUGEINT', _P5)})", 11), _P1)
    return f"""bytes AS (SELECT s, octet_length(encode(s)) AS n, list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i::INT + 1, 2))::UTINYINT) AS b FROM {source}),
stripes(s, n, b, pos, v1, v2, v3, v4) AS (
  SELECT s, n, b, 0::BIGINT, {", ".join(map(_int, start))} FROM bytes
  UNION ALL SELECT s, n, b, pos + 32, {", ".join(_round(f"v{k + 1}", _lane(f"pos + {8 * k}")) for k in range(4))} FROM stripes WHERE pos + 32 <= n),
opened AS (SELECT s, n, b, pos, CASE WHEN n >= 32 THEN {opened} ELSE {_int((seed + _P5) & _MASK)} END AS h, v1, v2, v3, v4 FROM stripes WHERE pos + 32 > n),
{merged}eights(s, n, b, pos, h) AS (SELECT s, n, b, pos, {_add("h", "n::UHUGEINT")} FROM merged4 UNION ALL SELECT s, n, b, pos + 8, {eight} FROM eights WHERE pos + 8 <= n),
fours AS (SELECT s, n, b, CASE WHEN pos + 4 <= n THEN pos + 4 ELSE pos END AS pos, CASE WHEN pos + 4 <= n THEN {four} ELSE h END AS h FROM eights WHERE pos + 8 > n),
ones(s, n, b, pos, h) AS (SELECT s, n, b, pos, h FROM fours UNION ALL SELECT s, n, b, pos + 1, {one} FROM ones WHERE pos < n),
last1 AS (SELECT s, {_mul(_fold("h", 33), _P2)} AS h FROM ones WHERE pos = n),
last2 AS (SELECT s, {_mul(_fold("h", 29), _P3)} AS h FROM last1),
hashed AS (SELECT s, ({_fold("h", 32)})::UBIGINT AS h FROM last2)"""


SIMHASH = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
kinds AS (SELECT DISTINCT s FROM cut),
{xxh64("kinds")},
bits AS (SELECT doc_id, {", ".join(f"sum((h >> {k}) & 1) * 2 > count(*) AS b{k}" for k in range(64))} FROM cut JOIN hashed USING (s) GROUP BY doc_id),
prints AS (SELECT doc_id, coalesce({" + ".join(f"b{k}::UBIGINT * {1 << k}" for k in range(64))}, 0)::UBIGINT AS fp FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN bits USING (doc_id)),
reps AS (SELECT fp, min(doc_id) AS rep FROM prints GROUP BY fp),
links AS (SELECT a.rep AS a, b.rep AS b FROM reps a JOIN reps b ON a.rep <> b.rep AND bit_count(xor(a.fp, b.fp)::BIT) <= 3),
reach(node, other) AS (SELECT rep, rep FROM reps UNION SELECT node, b FROM reach JOIN links ON other = a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN reps USING (fp) JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) ON node = rep"""

REPEATS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(raw[i + 1 : i + 100]::VARCHAR) AS h FROM d, range(0, greatest(n - 99, 0)) t(i)),
f AS (SELECT h, min((doc_id::HUGEINT << 40) + i) AS first FROM w GROUP BY h HAVING count(*) > 1),
gone AS (SELECT doc_id, i FROM w JOIN f USING (h) WHERE (doc_id::HUGEINT << 40) + i > first),
e AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM gone),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e) GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM s),
parts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(hex(raw[since + 1 : a]), '' ORDER BY a) || any_value(hex(raw[b + 1 :])) FILTER (back = 1) AS kept FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(kept), raw)) AS kept_sha256 FROM d LEFT JOIN parts USING (doc_id)"""
