"""DuckDB SQL for the registered queries, over the same whole tables."""

from __future__ import annotations

import re
from itertools import product

from helixmill import catalogs, tables as T
from helixmill.plans.queries import PROBES, family
from helixmill.sources.fasta import FIXTURE_BASES, FIXTURE_INSERTS, FIXTURE_LETTERS

_CASES = " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(FIXTURE_INSERTS))
DNA = f"""dna AS (SELECT doc_id AS seq_id, 'doc_' || doc_id AS seq_name, source,
  translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{FIXTURE_LETTERS}', '{FIXTURE_BASES}')
  || CASE doc_id % 13 {_CASES} END AS bases FROM documents),
lens AS (SELECT seq_id, length(bases) AS seq_len FROM dna)"""


def hits(patterns, name="hits", source="dna") -> str:
    """CTE of leftmost non-overlapping matches: mark, split at the marks, sum up the lengths."""
    one = [
        f"""SELECT seq_id, seq_name, bases, {n} AS ord, '{cls}' AS class, '{pid}' AS pattern_id, '{sub}' AS subclass,
        string_split_regex(regexp_replace(bases, '({rx})', '<\\1>', 'g'), '[<>]') AS parts FROM {source}"""
        for n, (cls, pid, sub, rx) in enumerate(patterns)
    ]
    return f"""{name}_p AS ({' UNION ALL '.join(one)}),
{name}_u AS (SELECT seq_id, seq_name, length(bases) AS seq_len, ord, class, pattern_id, subclass, unnest(parts) AS sequence, generate_subscripts(parts, 1) AS idx FROM {name}_p),
{name}_s AS (SELECT *, sum(length(sequence)) OVER (PARTITION BY seq_id, ord ORDER BY idx) AS stop FROM {name}_u),
{name} AS (SELECT seq_id, seq_name, seq_len, ord, class, pattern_id, subclass, sequence,
  CAST(stop - length(sequence) + 1 AS BIGINT) AS "start", CAST(stop AS BIGINT) AS "end", CAST(length(sequence) AS BIGINT) AS length FROM {name}_s WHERE idx % 2 = 0)"""


MOTIFS = f"""WITH {DNA}, {hits(PROBES)}, m AS (SELECT *, length / (length + 6.0) AS score, '+' AS strand, 'scan' AS method, ord AS det_order FROM hits)"""

# covered length per key: running maximum of ends, then the fresh part of each interval
def cover(keys: str, name: str) -> str:
    return f"""{name} AS (SELECT {keys}, CAST(sum(greatest(0, "end" - greatest("start" - 1, coalesce(done, "start" - 1)))) AS BIGINT) AS covered FROM (
  SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM m) GROUP BY {keys})"""


def count(letter: str, x="bases") -> str:
    return f"(length({x}) - length(replace({x}, '{letter}', '')))"


def counts(letters: str, x="bases") -> str:
    return "(" + " + ".join(count(c, x) for c in letters) + ")"


def runs(rx: str, x: str) -> str:
    return f"regexp_extract_all({x}, '{rx}')"


def total(rx: str, x: str) -> str:
    return f"coalesce(list_sum(list_transform({runs(rx, x)}, lambda r: length(r))), 0)"


def powers(rx: str, x: str, e: float) -> str:
    return f"coalesce(list_sum(list_transform({runs(rx, x)}, lambda r: pow(length(r), {e}))), 0)"


def pairs_of(x: str, test: str) -> str:
    """Neighbouring letter pairs that satisfy ``test`` (p is the pair)."""
    return f"len(list_filter(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)), lambda p: {test}))"


ALT = "regexp_full_match(p, '[AG][CT]|[CT][AG]')"
CGGC = "p IN ('CG','GC')"


def peak(x: str) -> str:
    w = f"least({T.G4_WINDOW}, length({x}))"
    return f"list_max(list_transform(range(1, length({x}) - {w} + 2), lambda i: abs({count('G', f'substr({x}, i, {w})')} - {count('C', f'substr({x}, i, {w})')})))"


def g4_region(x: str) -> str:
    w, n = f"least({T.G4_WINDOW}, length({x}))", f"len({runs('G{2,}', x)})"
    bal = f"(({count('G', x)} - {count('C', x)}) / length({x}))"
    return f"""greatest(0.0, least(1.0, {peak(x)} / {w}
  + CASE WHEN {n} >= 3 THEN least(0.5, 0.08 * ({n} - 2) * (({total('G{2,}', x)} / {n}) / 4.0)) ELSE 0 END
  - CASE WHEN {bal} < -0.3 THEN 0.2 WHEN {bal} < -0.1 THEN 0.1 ELSE 0 END)) * (length({x}) / {w})"""


REVCOMP = "reverse(translate(bases, 'ACGTacgt', 'TGCAtgca'))"

ORACLES: dict[str, str] = {}

ORACLES["seq_stats"] = f"""WITH {DNA} SELECT seq_id, length(bases) AS length, {count('A')} AS n_a, {count('T')} AS n_t, {count('G')} AS n_g, {count('C')} AS n_c, {count('N')} AS n_n,
  round(100.0 * {counts('GC')} / length(bases), 2) AS gc_percent, round(100.0 - 100.0 * {counts('GC')} / length(bases), 2) AS at_percent,
  round(CASE WHEN length(bases) < 2 THEN 0 WHEN length(bases) <= 13 THEN {counts('AT')} * 2 + {counts('GC')} * 4
    ELSE 64.9 + 41 * ((100.0 * {counts('GC')} / length(bases)) / 100) - 650 / length(bases) END, 1) AS tm
  FROM dna WHERE length(bases) > 0"""

ORACLES["sequence_flags"] = f"""WITH {DNA}, f AS (SELECT seq_id, bases, CASE WHEN bases = '' THEN 'Empty sequence' WHEN NOT regexp_full_match(bases, '[ATGCRYSWKMBDHVN-]*') THEN 'Invalid characters found'
  WHEN length(bases) < 10 THEN 'Sequence too short (minimum 10 bp)' ELSE 'Valid sequence' END AS message, {REVCOMP} AS rc FROM dna)
  SELECT seq_id, message, message = 'Valid sequence' AS ok, rc = bases AS palindrome, md5(rc) AS revcomp_md5, md5(rc) AS acgt_revcomp_md5, md5(bases) AS dna_md5,
  md5(array_to_string(list_transform(range(0, greatest(length(bases), 1), 80), lambda i: substr(bases, i + 1, 80)), chr(10))) AS wrapped_md5,
  CASE WHEN length(bases) > 50 THEN substr(bases, 1, 47) || '...' ELSE bases END AS short FROM f"""

ORACLES["fasta_lines"] = f"""WITH {DNA} SELECT md5('>' || seq_name || chr(10) || array_to_string(list_transform(range(0, greatest(length(bases), 1), 80), lambda i: substr(bases, i + 1, 80)), chr(10))) AS record_md5 FROM dna"""

ORACLES["fasta_round_trip"] = f"""WITH {DNA} SELECT seq_name, length(bases) AS n, md5(bases) AS bases_md5 FROM dna WHERE length(bases) > 0"""

_S = "sequence"
ORACLES["library_scores"] = f"""{MOTIFS} SELECT seq_id, class, subclass, "start",
  round({peak(_S)} / least(25, length), 6) AS g4hunter_score,
  round(CASE WHEN length < 12 OR len({runs('C{2,}', _S)}) < 3 THEN 0 ELSE least({total('C{2,}', _S)} / length + len({runs('C{2,}', _S)}) / 4 * 0.2, 1.0) END, 6) AS imotif_score,
  round(CASE WHEN length < 6 THEN 0 ELSE ({pairs_of(_S, ALT)} + 0.5 * {pairs_of(_S, CGGC)}) / (length - 1) END, 6) AS z_dna_score,
  round(CASE WHEN length < 4 THEN 0 ELSE least(({powers('A{3,}', _S, 1.5)} + {powers('T{3,}', _S, 1.5)}) / length, 1.0) END, 6) AS curvature_score,
  round(CASE WHEN length < 15 THEN 0 ELSE least(greatest({powers('[AG]{5,}', _S, 1.2)}, {powers('[CT]{5,}', _S, 1.2)}) / pow(length, 1.2), 1.0) END, 6) AS triplex_potential,
  round(CASE WHEN length < 20 THEN 0 ELSE least(abs({count('G', _S)} - {count('C', _S)}) / length * 0.6 + {counts('GC', _S)} / length * 0.4, 1.0) END, 6) AS r_loop_potential,
  round(CASE WHEN length < 20 THEN 0 ELSE least(abs({count('G', _S)} - {count('C', _S)}) / length * 0.6 + {counts('GC', _S)} / length * 0.4, 1.0) END, 6) AS qmrlfs_score,
  round(CASE WHEN length < 6 THEN 0 ELSE least({count('A', _S)} / length * 0.7 + {powers('A{3,}', _S, 1.2)} / length * 0.3, 1.0) END, 6) AS a_philic_score FROM m"""

ORACLES["legacy_scores"] = f"""{MOTIFS} SELECT seq_id, class, subclass, "start",
  round(CASE WHEN length < 10 THEN 0 ELSE ({count('G', _S)} - {count('C', _S)}) / length END, 6) AS g4,
  round(CASE WHEN length < 4 THEN 0 ELSE least(len({runs('[AT]{3,}', _S)}) / (length / 10), 1.0) END, 6) AS curvature,
  round(CASE WHEN length < 6 THEN 0 ELSE {pairs_of(_S, ALT)} / (length - 1) END, 6) AS z_dna,
  round(CASE WHEN length < 10 THEN 0 ELSE greatest({counts('GA', _S)} / length, {counts('CT', _S)} / length) END, 6) AS triplex FROM m"""


def _scan(name, rows):
    ORACLES[name] = f"""WITH {DNA}, {hits(rows)} SELECT seq_id, pattern_id, "start", "end" FROM hits"""


for _n, _p in (("scan_g_quadruplex", "g_quadruplex"), ("scan_i_motif", "i_motif"), ("scan_r_loop", "r_loop"), ("scan_triplex", "triplex")):
    _scan(_n, family(_p))
_scan("scan_seeds", [(d, str(sid), name, rx) for name, rx, sid, _, _, d in catalogs.SEEDS if sid != 6])

_TANDEM = re.compile(r"\(\[ATGC\](?:\{(\d+)\})?\)\\1\{(\d+),\}")
_LITERAL = re.compile(r"\(([ACGT]+)\)\\1\{(\d+),\}")
_APART = re.compile(r"\(\[ATGC\]\{(\d+),(\d+)\}\)\(\?:\[ATGC\]\{0,(\d+)\}\)\\1")


def _plain(rx: str) -> str | None:
    """The same matches without a back-reference; None for spaced ones."""
    if tandem := _TANDEM.fullmatch(rx):
        unit, more = int(tandem[1] or 1), int(tandem[2])
        return "|".join(f"(?:{''.join(u)}){{{more + 1},}}" for u in product("ACGT", repeat=unit))
    if literal := _LITERAL.fullmatch(rx):
        return f"(?:{literal[1]}){{{int(literal[2]) + 1},}}"
    return None if "\\1" in rx else rx


def _spaced(name: str, least: int, most: int, gap: int) -> str:
    """CTE of the number of hits per sequence of a unit, up to ``gap`` bases and the same unit: leftmost, longest unit, widest gap.

    Equal words at one distance in a row are a run, which tells how far the text agrees from each of its places."""
    near, n = most + gap, name
    return f"""{n}_l AS (SELECT seq_id, bases, unnest(range(0, length(bases), {near})) AS lo FROM dna),
{n}_pc AS (SELECT seq_id, lo, substr(bases, lo + 1, {near + least - 1}) AS piece FROM {n}_l),
{n}_o AS (SELECT seq_id, lo, piece, unnest(range(1, least({near}, length(piece) - {least - 1}) + 1)) AS off FROM {n}_pc),
{n}_w AS MATERIALIZED (SELECT seq_id, lo // {near} AS tile, lo + off AS pos, substr(piece, off, {least}) AS w FROM {n}_o),
{n}_t AS (SELECT * FROM {n}_w UNION ALL SELECT seq_id, tile - 1, pos, w FROM {n}_w),
{n}_j AS (SELECT a.seq_id, a.pos, b.pos - a.pos AS d FROM {n}_w a JOIN {n}_t b ON a.seq_id = b.seq_id AND a.tile = b.tile AND a.w = b.w WHERE b.pos - a.pos BETWEEN {least} AND {near}),
{n}_r AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, d ORDER BY pos) AS run FROM {n}_j),
{n}_e AS (SELECT seq_id, pos, d, least(max(pos) OVER (PARTITION BY seq_id, d, run) - pos + {least}, {most}, d) AS unit FROM {n}_r),
{n}_b AS (SELECT seq_id, pos, max(unit * {near + 1} + d) AS best FROM {n}_e WHERE unit >= d - {gap} GROUP BY 1, 2),
{n} AS (SELECT seq_id, list_reduce(list({{'i': pos, 'e': pos + best // {near + 1} + best % {near + 1}}} ORDER BY pos), lambda a, x: CASE WHEN x.i >= a.e THEN {{'i': a.i + 1, 'e': x.e}} ELSE a END, {{'i': 0, 'e': 0}}).i AS n FROM {n}_b GROUP BY 1)"""


_REG = [(r[1], r[4], r[6], _plain(r[3])) for r in catalogs.rows("registry")]
_FAR = [(r[1], f"far_{n}", *map(int, _APART.fullmatch(r[3]).groups())) for n, r in enumerate(catalogs.rows("registry")) if _plain(r[3]) is None]
_SIZES: dict[str, int] = {}
for _r in catalogs.rows("registry"):
    _SIZES[_r[1]] = _SIZES.get(_r[1], 0) + 1
_SIZE_ROWS = ", ".join(f"('{k}', {v})" for k, v in _SIZES.items())
ORACLES["pattern_counts"] = f"""WITH {DNA}, {hits([r for r in _REG if r[3]])}, {', '.join(_spaced(*r[1:]) for r in _FAR)},
  found AS (SELECT class, count(*) AS n FROM hits GROUP BY class {' '.join(f"UNION ALL SELECT '{r[0]}', sum(n) FROM {r[1]} HAVING count(*) > 0" for r in _FAR)})
  SELECT h.class, CAST(s.n AS BIGINT) AS n_patterns, CAST(h.n_hits AS BIGINT) AS n_hits FROM (SELECT class, sum(n) AS n_hits FROM found GROUP BY class) h
  JOIN (VALUES {_SIZE_ROWS}) s(class, n) ON s.class = h.class"""

ORACLES["raw_locations"] = f"""WITH {DNA}, {hits(PROBES)} SELECT DISTINCT seq_id, class, pattern_id, "start" - 1 AS "start", "end" FROM hits"""

ORACLES["a_tract_windows"] = f"""WITH {DNA}, {hits([("c", "p", "s", "[AT]{3,}")])},
  w AS (SELECT *, regexp_extract_all(sequence, 'A+T*|T+') AS f, regexp_extract_all({REVCOMP.replace('bases', 'sequence')}, 'A+T*|T+') AS r FROM hits),
  x AS (SELECT seq_id, "start", "end",
    list_max(list_transform(f, lambda b: {count('A', 'b')} + least({count('A', 'b')}, {count('T', 'b')}))) AS max_at,
    greatest(0, list_max(list_transform(f, lambda b: {count('T', 'b')} - {count('A', 'b')}))) AS max_t,
    list_max(list_transform(r, lambda b: {count('A', 'b')} + least({count('A', 'b')}, {count('T', 'b')}))) AS max_at_rc,
    greatest(0, list_max(list_transform(r, lambda b: {count('T', 'b')} - {count('A', 'b')}))) AS max_t_rc FROM w)
  SELECT *, greatest(max_at - max_t, max_at_rc - max_t_rc) >= 3 AS call FROM x"""


# short pieces first: substr walks from the start of its string
def _pieces(extra: int, step: int = 1000) -> str:
    return f"""l0 AS (SELECT seq_id, bases, unnest(range(0, length(bases), {step})) AS lo FROM dna), pc AS (SELECT seq_id, lo, substr(bases, lo + 1, {step} + {extra}) AS piece FROM l0)"""


_WORDS = "p AS (SELECT seq_id, lo, piece, unnest(range(1, least(1000, length(piece) - {k} + 1) + 1)) AS off FROM pc), k AS (SELECT seq_id, lo + off AS pos, substr(piece, off, {k}) AS w FROM p)"


def _tenmers(score: str, quick: str, test: str, digits: int) -> str:
    return f"""WITH {DNA}, {_pieces(9)}, {_WORDS.format(k=10)}, q AS MATERIALIZED (SELECT * FROM k WHERE regexp_matches(w, '{quick}')), s AS (SELECT seq_id, pos, {score} AS v FROM q WHERE {test}),
  f AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY seq_id ORDER BY pos) + 10 THEN 0 ELSE 1 END AS head FROM s {'WHERE v >= 50' if 'IN' not in test else ''}),
  g AS (SELECT *, sum(head) OVER (PARTITION BY seq_id ORDER BY pos) AS island FROM f)
  SELECT seq_id, min(pos) AS "start", max(pos) + 9 AS "end", count(*) AS n_hits, round(sum(v), {digits}) AS score FROM g GROUP BY seq_id, island"""


def _step(x, table):
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


# the scored 10-mers by another road: sums of step values, stated here on their own
Z_STEP = {
    "CG": 7.0,
    "GC": 7.0,
    "AC": 1.25,
    "CA": 1.25,
    "GT": 1.25,
    "TG": 1.25,
    "AT": 1.0,
    "TA": 1.0,
}
A_PHILIC_STEP = {
    "ACCC": 0.848,
    "AGGG": 3.7004,
    "CCCA": 2.0704,
    "CCCC": 2.5361,
    "CCCG": 0.848,
    "CCCT": 3.7004,
    "CCGG": 0.2591,
    "CCTA": 1.585,
    "CGGG": 0.848,
    "GCCC": 2.4021,
    "GGCC": 0.1343,
    "GGGC": 2.4021,
    "GGGG": 2.5361,
    "GGGT": 0.848,
    "TAGG": 1.585,
    "TGGG": 2.0704,
}
ORACLES["z_dna_regions"] = _tenmers(" + ".join(f"({_step(f'substr(w, {t}, 2)', Z_STEP)})" for t in range(1, 10)), "CGC|GCG", "TRUE", 4)
_LISTED = ", ".join(f"'{k}'" for k in A_PHILIC_STEP)
ORACLES["a_philic_regions"] = _tenmers(
    "(" + " + ".join(f"({_step(f'substr(w, {t}, 4)', A_PHILIC_STEP)})" for t in range(1, 8)) + ") / 7",
    "GGG|CCC",
    " AND ".join(f"substr(w, {t}, 4) IN ({_LISTED})" for t in range(1, 8)),
    4,
)

ORACLES["tandem_repeats"] = f"""WITH RECURSIVE {DNA}, {_pieces(9, 200)}, a AS (SELECT seq_id, lo, piece, unnest(range(1, least(200, length(piece)) + 1)) AS off FROM pc),
  b AS (SELECT seq_id, lo + off AS pos, substr(piece, off, 10) AS w FROM a), u AS (SELECT seq_id, pos, w, unnest(range(1, 10)) AS k FROM b),
  q AS (SELECT seq_id, k, pos FROM u WHERE substr(w, 1, 1) = substr(w, k + 1, 1)),
  g AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, k ORDER BY pos) AS island FROM q),
  r AS (SELECT seq_id, k, min(pos) AS s, count(*) AS r FROM g GROUP BY seq_id, k, island HAVING count(*) >= greatest(k, CAST(ceil(10.0 / k) AS INTEGER) * k - k)),
  h AS (SELECT *, CASE WHEN s < lag(s + r + k) OVER (PARTITION BY seq_id, k ORDER BY s) THEN 0 ELSE 1 END AS head FROM r),
  c AS (SELECT seq_id, k, s, r, sum(head) OVER (PARTITION BY seq_id, k ORDER BY s) AS chain FROM h),
  o AS (SELECT *, row_number() OVER (PARTITION BY seq_id, k, chain ORDER BY s) AS rn FROM c),
  w AS (SELECT seq_id, k, chain, rn, s AS a, CAST(floor((r + k) / k) AS BIGINT) AS copies, s + CAST(floor((r + k) / k) AS BIGINT) * k AS busy, TRUE AS hit FROM o WHERE rn = 1
    UNION ALL
    SELECT o.seq_id, o.k, o.chain, o.rn, greatest(o.s, w.busy),
      CAST(floor((o.s + o.r - greatest(o.s, w.busy) + o.k) / o.k) AS BIGINT),
      CASE WHEN o.s + o.r - greatest(o.s, w.busy) >= o.k AND floor((o.s + o.r - greatest(o.s, w.busy) + o.k) / o.k) * o.k >= 10
        THEN greatest(o.s, w.busy) + CAST(floor((o.s + o.r - greatest(o.s, w.busy) + o.k) / o.k) AS BIGINT) * o.k ELSE w.busy END,
      o.s + o.r - greatest(o.s, w.busy) >= o.k AND floor((o.s + o.r - greatest(o.s, w.busy) + o.k) / o.k) * o.k >= 10
    FROM w JOIN o ON o.seq_id = w.seq_id AND o.k = w.k AND o.chain = w.chain AND o.rn = w.rn + 1)
  SELECT seq_id, CAST(a AS BIGINT) AS "start", CAST(a + copies * k - 1 AS BIGINT) AS "end", CAST(k AS INTEGER) AS unit, CAST(copies AS INTEGER) AS copies FROM w WHERE hit"""

# direct, inverted and mirror repeats: the pair search is too slow in SQL on whole low-complexity
# texts; tests/test_kernels.py checks them against brute force instead

ORACLES["inverted_seed_pairs"] = f"""WITH {DNA}, {_pieces(5)}, {_WORDS.format(k=6)},
  t AS (SELECT *, pos // 106 AS tile FROM k), u AS (SELECT seq_id, reverse(translate(w, 'ACGT', 'TGCA')) AS w, pos, unnest([pos // 106, pos // 106 - 1]) AS tile FROM k)
  SELECT a.seq_id, b.pos - a.pos AS delta, count(*) AS n FROM t a JOIN u b ON a.seq_id = b.seq_id AND a.w = b.w AND a.tile = b.tile WHERE b.pos - a.pos BETWEEN 6 AND 106 GROUP BY 1, 2"""

_RIZ = [("r_loop", pid, fam, rx) for fam, rx, pid, *_ in catalogs.RIZ]
ORACLES["r_loop_zones"] = f"""WITH {DNA}, {hits(_RIZ)},
  z AS (SELECT h.*, d.bases, round_even({count('G', 'sequence')} * 100.0 / length, 2) AS riz_g FROM hits h JOIN dna d USING (seq_id)),
  c AS (SELECT *, unnest(range("end" + 50, least(length(bases), "end" + 2000), 100)) AS ws FROM z WHERE riz_g >= 50),
  e AS (SELECT *, unnest(range(ws + 50, least(length(bases), ws + 2000), 50)) AS we FROM c),
  g AS (SELECT seq_id, subclass, "start", ws, we, round_even({count('G', 'substr(bases, ws + 1, we - ws)')} * 100.0 / (we - ws), 2) AS pct FROM e),
  b AS (SELECT *, row_number() OVER (PARTITION BY seq_id, subclass, "start" ORDER BY pct * (we - ws) / 100.0 DESC, ws, we) AS rn FROM g WHERE pct >= 40)
  SELECT z.seq_id, z.subclass AS model, z."start" AS riz_start, z."end" AS riz_end, riz_g AS riz_g_percent, b.ws AS rez_start, b.we AS rez_end, b.pct AS rez_g_percent
  FROM z LEFT JOIN b ON b.seq_id = z.seq_id AND b.subclass = z.subclass AND b."start" = z."start" AND b.rn = 1 WHERE riz_g >= 50"""

_G4 = [("g", pid, fam, rx) for fam, rx, pid, *_ in catalogs.G4_FAMILIES]
ORACLES["g4_candidates"] = f"""WITH {DNA}, {hits(_G4)} SELECT seq_id, subclass AS family, "start", "end", round({g4_region(_S)}, 6) AS score FROM hits WHERE length >= 10"""

_CANON = f"""CASE WHEN length < 12 OR len({runs('C{2,}', _S)}) < 3 THEN 0 ELSE greatest(0.0, least(1.0, {total('C{2,}', _S)} / length + least(0.4, 0.12 * (len({runs('C{2,}', _S)}) - 2)))) END"""
_HURS = f"""greatest(0.0, least(1.0, least(0.6, {counts('AC', _S)} / length * 0.8) + CASE WHEN len({runs('A{3,}', _S)}) >= 1 AND len({runs('C{3,}', _S)}) >= 3 THEN 0.5 ELSE 0 END + CASE WHEN linker IN (4, 5) THEN 0.25 ELSE 0.12 END))"""
_HUR = [("i", str(link), "ac_motif_hur", rx) for _, link, rx in catalogs.hur_patterns()]
_IMO = [("i", catalogs.CANONICAL_I_MOTIF[2], "canonical_imotif", catalogs.CANONICAL_I_MOTIF[1])] + [("i", str(link), "hur_ac_motif", rx) for _, link, rx in catalogs.hur_patterns()]
ORACLES["imotif_candidates"] = f"""WITH {DNA}, rev AS (SELECT seq_id, seq_name, {REVCOMP} AS bases FROM dna),
  {hits(_IMO, 'r')}, {hits(_HUR, 'hf')}, {hits(_HUR, 'hr', 'rev')},
  h AS (SELECT seq_id, "start", "end", sequence, length, CAST(pattern_id AS INTEGER) AS linker FROM hf UNION ALL
        SELECT seq_id, seq_len - "end" + 1, seq_len - "start" + 1, sequence, length, CAST(pattern_id AS INTEGER) FROM hr)
  SELECT seq_id, subclass AS family, "start", "end", round({_CANON}, 6) AS score FROM r UNION ALL
  SELECT seq_id, 'ac_motif_hur', "start", "end", round({_HURS}, 6) FROM h"""


def _greedy(source: str, order: str, keys: str = "seq_id") -> str:
    """Rank rows per key, then take them one by one if they meet nothing taken before."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}),
  g AS (SELECT seq_id, rn, TRUE AS kept, [{{'s': "start" - 1, 'e': "end"}}] AS sel FROM o WHERE rn = 1
    UNION ALL
    SELECT o.seq_id, o.rn, len(list_filter(g.sel, lambda x: x.s < o."end" AND o."start" - 1 < x.e)) = 0,
      CASE WHEN len(list_filter(g.sel, lambda x: x.s < o."end" AND o."start" - 1 < x.e)) = 0 THEN list_append(g.sel, {{'s': o."start" - 1, 'e': o."end"}}) ELSE g.sel END
    FROM g JOIN o ON o.seq_id = g.seq_id AND o.rn = g.rn + 1)"""


_G4_RANK = " ".join(f"WHEN '{f}' THEN {n}" for n, f in enumerate(T.G4_PRIORITY))
_G4_NAME = " ".join(f"WHEN '{f}' THEN '{s}'" for f, _, _, s, *_ in catalogs.G4_FAMILIES)
ORACLES["g4_motifs"] = f"""WITH RECURSIVE {DNA}, {hits(_G4)}, c AS (SELECT *, {g4_region(_S)} AS score FROM hits WHERE length >= 10),
  {_greedy('c', f'''score DESC, CASE subclass {_G4_RANK} END, length DESC, ord, "start"''')}
  SELECT o.seq_id, 'G-Quadruplex' AS class, CASE subclass {_G4_NAME} END AS subclass, o."start", o."end", o.length, round(o.score, 3) AS score FROM g JOIN o USING (seq_id, rn) WHERE kept"""

_IMOTIF_RANK = "CASE family WHEN 'canonical_imotif' THEN 1 WHEN 'hur_ac_motif' THEN 2 ELSE 999 END"
ORACLES["imotif_motifs"] = f"""WITH RECURSIVE {DNA}, rev AS (SELECT seq_id, seq_name, {REVCOMP} AS bases FROM dna),
  {hits(_IMO, 'r')}, {hits(_HUR, 'hf')}, {hits(_HUR, 'hr', 'rev')},
  h AS (SELECT seq_id, "start", "end", sequence, length, CAST(pattern_id AS INTEGER) AS linker, 0 AS strand, ord FROM hf UNION ALL
        SELECT seq_id, seq_len - "end" + 1, seq_len - "start" + 1, sequence, length, CAST(pattern_id AS INTEGER), 1, ord FROM hr),
  c AS (SELECT seq_id, subclass AS family, "start", "end", length, {_CANON} AS score, 0 AS strand, ord FROM r WHERE subclass <> 'canonical_imotif' OR length >= 10
        UNION ALL SELECT seq_id, 'ac_motif_hur', "start", "end", length, {_HURS}, strand, ord FROM h),
  {_greedy('c', f'score DESC, {_IMOTIF_RANK}, length DESC, CASE WHEN strand = 0 AND family = \'hur_ac_motif\' THEN ord END, "start", strand, ord')}
  SELECT o.seq_id, 'i-Motif' AS class, CASE family WHEN 'canonical_imotif' THEN 'Canonical i-Motif' ELSE 'HUR AC-Motif' END AS subclass, o."start", o."end", o.length, round(o.score, 3) AS score
  FROM g JOIN o USING (seq_id, rn) WHERE kept"""

_RIZ_NAME = " ".join(f"WHEN '{fam}' THEN '{sub}'" for fam, _, _, sub, *_ in catalogs.RIZ)
ORACLES["r_loop_motifs"] = "WITH RECURSIVE" + ORACLES["r_loop_zones"].removeprefix("WITH").replace("c AS (SELECT *, unnest", "cells AS (SELECT *, unnest").replace("AS we FROM c)", "AS we FROM cells)").replace("g AS (SELECT seq_id, subclass", "grid AS (SELECT seq_id, subclass").replace("AS rn FROM g WHERE", "AS rn FROM grid WHERE").replace("\n  SELECT z.seq_id", ",\n  zones AS (SELECT z.seq_id") + f"""),
  c AS (SELECT seq_id, model, riz_start AS "start", coalesce(rez_end, riz_end) AS "end", riz_g_percent AS riz, coalesce(rez_g_percent * (rez_end - rez_start) / 100.0, 0.0) AS zone FROM zones),
  {_greedy('c', 'riz + zone DESC, "end" - "start" DESC, model, "start"')}
  SELECT o.seq_id, 'R-Loop' AS class, CASE o.model {_RIZ_NAME} END AS subclass, o."start", CAST(o."end" AS BIGINT) AS "end", CAST(o."end" - o."start" + 1 AS BIGINT) AS length, round(o.riz / 100.0 + o.zone / 100.0, 3) AS score
  FROM g JOIN o USING (seq_id, rn) WHERE kept"""

ORACLES["z_dna_motifs"] = f"""SELECT seq_id, 'Z-DNA' AS class, 'Z-DNA' AS subclass, "start", "end", "end" - "start" + 1 AS length, round(score, 3) AS score FROM ({ORACLES['z_dna_regions']}) WHERE score > 50
  UNION ALL SELECT seq_id, 'A-philic_DNA', 'A-philic DNA', "start", "end", "end" - "start" + 1, round(score, 3) FROM ({ORACLES['a_philic_regions'].replace('4) AS score', '6) AS score')}) WHERE score > 0.5"""

ORACLES["select_non_overlapping"] = MOTIFS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", c AS (SELECT * FROM m),
  {_greedy('c', 'score DESC, length DESC, ord, "start"')}
  SELECT o.seq_id, o.class, o.subclass, o."start", o."end" FROM g JOIN o USING (seq_id, rn) WHERE kept"""

ORACLES["merge_intervals"] = f"""{MOTIFS}, f AS (SELECT *, CASE WHEN "start" - 1 > max("end") OVER (PARTITION BY seq_id ORDER BY "start", "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS head FROM m),
  g AS (SELECT *, sum(head) OVER (PARTITION BY seq_id ORDER BY "start", "end", ord ROWS UNBOUNDED PRECEDING) AS island FROM f)
  SELECT seq_id, min("start") - 1 AS "start", max("end") AS "end", count(*) AS n FROM g GROUP BY seq_id, island"""


def _pairs(cond: str) -> str:
    return f"""{MOTIFS}, t AS (SELECT *, unnest(range("start" // 500, "end" // 500 + 1)) AS tile FROM m),
  j AS (SELECT a.seq_id, a.class AS class_1, b.class AS class_2, least(a."start", b."start") AS "start", greatest(a."end", b."end") AS "end", (a.score + b.score) / 2 AS score,
    (least(a."end", b."end") - greatest(a."start", b."start")) / least(a."end" - a."start", b."end" - b."start") AS ratio
    FROM t a JOIN t b ON a.seq_id = b.seq_id AND a.tile = b.tile AND a.ord < b.ord AND a.class <> b.class
    WHERE a.tile = greatest(a."start", b."start") // 500 AND least(a."end", b."end") > greatest(a."start", b."start"))
  SELECT seq_id, class_1, class_2, "start", "end", round(score, 6) AS score FROM j WHERE {cond}"""


ORACLES["hybrid_pairs"] = _pairs("ratio > 0.3 AND ratio < 1.0")
ORACLES["hybrid_pairs_legacy"] = _pairs("ratio >= 0.3 AND ratio <= 0.7")

ORACLES["cluster_windows"] = f"""{MOTIFS}, n AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY "start", ord) AS rn FROM m),
  c AS (SELECT a.seq_id, a.rn, min(b."start") AS "start", max(b."end") AS "end", count(*) AS n, count(DISTINCT b.class) AS d, avg(b.length) AS s FROM n a JOIN n b ON a.seq_id = b.seq_id AND b.rn >= a.rn AND b."start" <= a."start" + 500 GROUP BY a.seq_id, a.rn)
  SELECT seq_id, 'High-density cluster (' || n || ' motifs)' AS subclass, "start", "end", n AS motif_count, d AS class_diversity, round(s, 3) AS score FROM c WHERE n >= 3"""

ORACLES["coverage"] = f"""{MOTIFS}, {cover('seq_id, class', 'c')} SELECT * FROM c"""
_DENS = f"""{cover('seq_id, class', 'cc')}, {cover('seq_id', 'co')}, dens AS (SELECT seq_id, class, round(least(covered * 100.0 / seq_len, 100.0), 4) AS density_percent
  FROM (SELECT * FROM cc UNION ALL SELECT seq_id, 'Overall', covered FROM co) JOIN lens USING (seq_id))"""
ORACLES["genomic_density"] = f"{MOTIFS}, {_DENS} SELECT * FROM dens"
_POS = """cnt AS (SELECT seq_id, class, count(*) AS n FROM m GROUP BY seq_id, class UNION ALL SELECT seq_id, 'Overall', count(*) FROM m GROUP BY seq_id)"""
ORACLES["positional_density"] = f"{MOTIFS}, {_POS} SELECT seq_id, class, round(n / (seq_len / 1000.0), 2) AS density FROM cnt JOIN lens USING (seq_id)"
ORACLES["density_table"] = f"""{MOTIFS}, {_DENS}, {_POS} SELECT seq_id, class, density_percent, round(n / (seq_len / 1000.0), 2) AS per_kbp, round(n / (seq_len / 1000000.0), 2) AS per_mbp
  FROM dens JOIN cnt USING (seq_id, class) JOIN lens USING (seq_id)"""
_STATS = f"""{cover('seq_id', 'co')}, st AS (SELECT lens.seq_id, coalesce(n, 0) AS total_motifs, CASE WHEN seq_len > 0 THEN round(coalesce(covered, 0) * 100.0 / seq_len, 2) ELSE 0 END AS coverage_percent,
  CASE WHEN seq_len > 0 THEN round(coalesce(n, 0) / (seq_len / 1000.0), 2) ELSE 0 END AS density_per_kb, coalesce(c, 0) AS classes_detected, coalesce(s, 0) AS subclasses_detected,
  floor((2000 * us + n * 1000000) // (n * 2000000)) / 1000 AS score_mean, round(sqrt(CAST(n * uss - us * us AS DOUBLE)) / n / 1000000, 3) AS score_std, round(s0, 3) AS score_min, round(s1, 3) AS score_max, floor((20 * ul + n) // (n * 2)) / 10 AS length_mean, round(sqrt(CAST(n * ull - ul * ul AS DOUBLE)) / n, 1) AS length_std, l0 AS length_min, l1 AS length_max
  FROM lens LEFT JOIN (SELECT seq_id, count(*) AS n, count(DISTINCT class) AS c, count(DISTINCT subclass) AS s, sum(CAST(round(score * 1000000) AS HUGEINT)) AS us, sum(CAST(round(score * 1000000) AS HUGEINT) * CAST(round(score * 1000000) AS HUGEINT)) AS uss, min(score) AS s0, max(score) AS s1,
    sum(CAST(length AS HUGEINT)) AS ul, sum(CAST(length AS HUGEINT) * length) AS ull, min(length) AS l0, max(length) AS l1 FROM m GROUP BY seq_id) a ON a.seq_id = lens.seq_id LEFT JOIN co ON co.seq_id = lens.seq_id)"""
ORACLES["motif_statistics"] = f"{MOTIFS}, {_STATS} SELECT * FROM st"
ORACLES["sequence_summary"] = f"""{MOTIFS} SELECT seq_id, count(*) AS total_motifs, count(DISTINCT class) AS classes_detected, count(DISTINCT subclass) AS subclasses_detected, round(avg(score), 3) AS score_mean, round(avg(length), 1) AS length_mean FROM m GROUP BY seq_id"""
ORACLES["summary_table"] = f"""{MOTIFS}, {_STATS} SELECT seq_id, length(bases) AS length_bp, round(100.0 * {counts('GC')} / length(bases), 2) AS gc_percent, total_motifs, coverage_percent, density_per_kb, classes_detected, subclasses_detected
  FROM dna JOIN st USING (seq_id) WHERE length(bases) > 0"""
ORACLES["class_summary"] = f"{MOTIFS} SELECT class, count(*) AS n, round(avg(length), 1) AS avg_length, round(avg(score), 3) AS avg_score FROM m GROUP BY class"
ORACLES["class_tree"] = f"{MOTIFS} SELECT class, subclass, count(*) AS n, CAST(grouping(class, subclass) AS BIGINT) AS level FROM m GROUP BY ROLLUP (class, subclass)"
ORACLES["subclass_breakdown"] = f"""{MOTIFS} SELECT class, subclass, n, CAST(sum(n) OVER (PARTITION BY class) AS BIGINT) AS class_total, count(*) OVER (PARTITION BY class) AS n_subclasses FROM (SELECT class, subclass, count(*) AS n FROM m GROUP BY class, subclass)"""
ORACLES["top_classes"] = f"{MOTIFS} SELECT class, count(*) AS n FROM m GROUP BY class ORDER BY class LIMIT 5"
ORACLES["coverage_track"] = f"""{MOTIFS} SELECT seq_id, class, dense_rank() OVER (ORDER BY class) - 1 AS lane, "start" - 1 AS start0, length, length > seq_len * 0.02 AS labelled FROM m"""
for _n, _v in (("length_distribution", "length"), ("score_distribution", "score")):
    ORACLES[_n] = f"""{MOTIFS} SELECT class, count(*) AS n, round(avg({_v}), 6) AS mean, round(quantile_cont({_v}, 0.25), 6) AS q1, round(quantile_cont({_v}, 0.5), 6) AS median, round(quantile_cont({_v}, 0.75), 6) AS q3,
  round(stddev_pop({_v}), 6) AS std, round(CAST(min({_v}) AS DOUBLE), 6) AS min, round(CAST(max({_v}) AS DOUBLE), 6) AS max FROM m GROUP BY class"""
ORACLES["score_histogram"] = f"""{MOTIFS}, r AS (SELECT class, min(length) AS lo, max(length) AS hi FROM m GROUP BY class)
  SELECT class, CAST(CASE WHEN hi > lo THEN least(floor((length - lo) / ((hi - lo) / 20)), 19) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM m JOIN r USING (class) GROUP BY 1, 2"""
ORACLES["density_heatmap"] = f"""{MOTIFS}, z AS (SELECT seq_id, seq_len, greatest(1, seq_len // 1000) AS bins FROM lens), w AS (SELECT *, seq_len / bins AS width FROM z),
  cells AS (SELECT seq_id, class, CAST(unnest(range(0, bins)) AS INTEGER) AS bin, width FROM (SELECT DISTINCT seq_id, class FROM m) JOIN w USING (seq_id))
  SELECT c.seq_id, c.class, c.bin, count(m."start") AS n FROM cells c LEFT JOIN m ON m.seq_id = c.seq_id AND m.class = c.class AND m."end" > c.bin * c.width AND m."start" < (c.bin + 1) * c.width GROUP BY 1, 2, 3"""
_PIVOT = ", ".join(f"count(*) FILTER (class = '{c}') AS \"{c.replace('-', '_')}\"" for c in sorted({p[0] for p in PROBES}))
ORACLES["genome_summary"] = f"""{MOTIFS}, b AS (SELECT source AS genome, CAST(sum(length(bases)) AS BIGINT) AS length_bp FROM dna GROUP BY source),
  t AS (SELECT source AS genome, count(*) AS total_motifs, count(DISTINCT class) AS unique_classes, {_PIVOT} FROM m JOIN dna USING (seq_id) GROUP BY source)
  SELECT *, round(total_motifs / length_bp * 1000, 6) AS motifs_per_kb FROM b JOIN t USING (genome)"""
ORACLES["scan_summary"] = f"{MOTIFS} SELECT count(*) AS total_motifs, count(DISTINCT class) AS classes_detected, count(DISTINCT subclass) AS subclasses_detected, round(avg(score), 6) AS avg_score FROM m"

_EXP = ", ".join(f"({n}, '{c}', '{s}')" for n, (c, subs) in enumerate(T.EXPECTED_SUBCLASSES.items()) for s in subs)


def _alias(col, table):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {col} END AS {col}"


ORACLES["detection_report"] = f"""{MOTIFS}, q AS (SELECT {_alias('class', T.REPORT_CLASS_ALIASES)}, {_alias('subclass', T.REPORT_SUBCLASS_ALIASES)} FROM m),
  x(ord, class, subclass) AS (VALUES {_EXP}), s AS (SELECT class, subclass, count(*) AS n FROM q GROUP BY 1, 2),
  p AS (SELECT class, CAST(sum(n) AS BIGINT) AS n, string_agg(subclass, '; ' ORDER BY subclass) AS det FROM s GROUP BY class),
  a AS (SELECT class, string_agg(subclass, '; ' ORDER BY subclass) AS mis FROM x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.class = x.class AND s.subclass = x.subclass) AND subclass NOT LIKE 'Dynamic%' GROUP BY class),
  c AS (SELECT class, min(ord) AS ord, count(*) AS k, string_agg(subclass, '; ' ORDER BY subclass) AS al FROM x GROUP BY class)
  SELECT c.ord, c.class, CASE WHEN p.n IS NULL THEN 'NOT_DETECTED' ELSE 'DETECTED' END AS status, coalesce(p.n, 0) AS count, k AS expected_subclasses, coalesce(det, '') AS detected_subclasses,
  CASE WHEN p.n IS NULL THEN al ELSE coalesce(mis, '') END AS missing_subclasses FROM c LEFT JOIN p ON p.class = c.class LEFT JOIN a ON a.class = c.class"""
ORACLES["quality_issues"] = f"""{MOTIFS}, q AS (SELECT *, CASE WHEN ord = 3 THEN length + 1 ELSE length END AS n2, lead("start") OVER w AS ns FROM m WINDOW w AS (PARTITION BY seq_id, class ORDER BY "start", "end")),
  i AS (SELECT class, unnest(list_filter([CASE WHEN "start" >= "end" THEN 'Invalid coordinates (start >= end)' END, CASE WHEN "end" - "start" + 1 <> n2 THEN 'Length inconsistent with coordinates' END,
    CASE WHEN length(sequence) <> n2 THEN 'Sequence length doesn''t match reported length' END, CASE WHEN ns < "end" THEN 'Overlapping motifs in class' END], lambda x: x IS NOT NULL)) AS issue FROM q)
  SELECT class, issue, count(*) AS n FROM i GROUP BY 1, 2"""
ORACLES["filters"] = f"""{MOTIFS} SELECT seq_id, class, subclass, "start", "end" FROM m WHERE class IN ('Z-DNA', 'Triplex') AND score >= 0.6 AND length BETWEEN 12 AND 40"""
ORACLES["top_hits"] = f"""{MOTIFS} SELECT seq_id, rank, class, "start", "end" FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY length DESC, "start", pattern_id) AS rank FROM m) WHERE rank <= 3"""
_COL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.BED_COLOURS.items())
ORACLES["bed_rows"] = f"""{MOTIFS} SELECT seq_name AS chrom, "start" - 1 AS start0, "end", class || '_' || subclass AS name, CAST(trunc(least(1000, greatest(0, score * 1000))) AS INTEGER) AS score, strand, "start" - 1 AS thick_start, "end" AS thick_end, CASE class {_COL} ELSE '128,128,128' END AS colour FROM m"""
ORACLES["gff3_rows"] = f"""{MOTIFS} SELECT seq_name AS seqid, 'helixmill' AS source, 'Non_B_DNA_motif' AS type, "start", "end", '.' AS score, strand, '.' AS phase,
  'ID=motif_' || row_number() OVER (PARTITION BY seq_id ORDER BY "start", "end", class, subclass) || ';Name=' || class || '_' || subclass || ';motif_class=' || class || ';motif_subclass=' || subclass || ';length=' || length || ';method=' || method AS attributes FROM m"""
_HAVE = {"ID": "seq_name || '_' || pattern_id || '_' || \"start\"", "Sequence_Name": "seq_name", "Class": "class", "Subclass": "subclass", "Pattern_ID": "pattern_id", "Start": 'CAST("start" AS VARCHAR)', "End": 'CAST("end" AS VARCHAR)', "Length": "CAST(length AS VARCHAR)", "Sequence": "sequence", "Method": "method", "Strand": "strand"}
ORACLES["export_frame"] = f"{MOTIFS} SELECT " + ", ".join(f"{_HAVE.get(c, chr(39) + 'NA' + chr(39))} AS \"{c}\"" for c in T.EXPORT_COLUMNS) + " FROM m"
ORACLES["display_rows"] = f"""{MOTIFS} SELECT class, subclass, CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end", CAST(length AS VARCHAR) AS length, CASE WHEN length > 50 THEN substr(sequence, 1, 47) || '...' ELSE sequence END AS sequence, 'N/A' AS score, strand FROM m"""
ORACLES["canonicalize"] = f"""{MOTIFS} SELECT class AS "Class", CASE WHEN subclass = 'eGZ' THEN 'Other' ELSE subclass END AS "Subclass", "start" AS "Start", "end" AS "End", CASE WHEN length > 20 THEN length ELSE "end" - "start" END AS "Length",
  round(score, 6) AS "Actual_Score", round(score, 6) AS "Score", 0.0 AS "Normalized_Score", sequence AS "Motif", seq_name AS "Sequence_Name" FROM m"""


def _shuffled(n):
    return f"""it AS (SELECT seq_id AS origin_id, unnest(range(0, {n})) AS iteration, bases FROM dna), pos AS (SELECT origin_id, iteration, bases, unnest(range(0, length(bases))) AS p FROM it),
  sh AS (SELECT origin_id, iteration, string_agg(substr(bases, p + 1, 1), '' ORDER BY md5('42_' || origin_id || '_' || iteration || '_' || p)) AS bases FROM pos GROUP BY origin_id, iteration)"""


ORACLES["shuffle"] = f"""WITH {DNA}, {_shuffled(1)} SELECT it.origin_id, CAST(it.iteration AS INTEGER) AS iteration, md5(coalesce(sh.bases, '')) AS bases_md5 FROM it LEFT JOIN sh USING (origin_id, iteration)"""

_EP = [PROBES[2], PROBES[6]]


def _dens(src, name):
    return f"""{name}_d AS (SELECT seq_id, class, sum(greatest(0, "end" - greatest("start" - 1, coalesce(done, "start" - 1)))) AS covered FROM (SELECT *, max("end") OVER (PARTITION BY seq_id, class ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done
  FROM (SELECT seq_id, class, "start", "end" FROM {src} UNION ALL SELECT seq_id, 'Overall', "start", "end" FROM {src})) GROUP BY seq_id, class)"""


ORACLES["enrichment"] = f"""WITH {DNA}, {_shuffled(3)}, sq AS (SELECT origin_id * 10 + iteration AS seq_id, 'x' AS seq_name, bases FROM sh), {hits(_EP, 'ob')}, {hits(_EP, 'bk', 'sq')}, {_dens('ob', 'o')}, {_dens('bk', 'b')},
  obs AS (SELECT seq_id, class, round(least(covered * 100.0 / seq_len, 100), 4) AS density FROM o_d JOIN lens USING (seq_id)),
  bg AS (SELECT b_d.seq_id // 10 AS origin, b_d.seq_id % 10 AS iteration, class, round(least(covered * 100.0 / seq_len, 100), 4) AS density FROM b_d JOIN lens ON lens.seq_id = b_d.seq_id // 10),
  f AS (SELECT obs.seq_id, obs.class, obs.density AS od, coalesce(bg.density, 0) AS bd FROM (SELECT *, unnest([0, 1, 2]) AS iteration FROM obs) obs LEFT JOIN bg ON bg.origin = obs.seq_id AND bg.class = obs.class AND bg.iteration = obs.iteration),
  a AS (SELECT seq_id, class, od, avg(bd) AS mean, stddev_pop(bd) AS std, avg(CASE WHEN bd >= od THEN 1.0 ELSE 0.0 END) AS p FROM f GROUP BY 1, 2, 3),
  n AS (SELECT seq_id, class, count(*) AS k FROM ob GROUP BY 1, 2 UNION ALL SELECT seq_id, 'Overall', count(*) FROM ob GROUP BY 1)
  SELECT a.seq_id, a.class, od AS observed_density, round(mean, 4) AS background_mean, round(std, 4) AS background_std, CASE WHEN mean > 0 THEN round(od / mean, 2) WHEN od > 0 THEN 100.0 ELSE 1.0 END AS fold_for_chart,
  round(p, 4) AS p_value, k AS observed_count, CASE WHEN round(p, 4) < 0.001 THEN '***' WHEN round(p, 4) < 0.01 THEN '**' WHEN round(p, 4) < 0.05 THEN '*' ELSE 'ns' END AS significance FROM a JOIN n ON n.seq_id = a.seq_id AND n.class = a.class"""


# --- whole-sequence scores, contributing words, choices across classes ---------------------------
def _inner(name: str, end: str) -> str:
    """The oracle of a detector's motifs up to its selection, as CTEs; rows kept are in g and o."""
    text = ORACLES[name].removeprefix("WITH RECURSIVE")
    return text[: text.rindex(end)]


ORACLES["detector_scores"] = f"""SELECT seq_id, 'Z-DNA' AS class, round(sum(score), 4) AS score FROM ({ORACLES['z_dna_regions']}) GROUP BY 1
  UNION ALL SELECT seq_id, 'A-philic_DNA', round(sum(score), 4) FROM ({ORACLES['a_philic_regions'].replace('4) AS score', '6) AS score')}) GROUP BY 1
  UNION ALL SELECT * FROM (WITH RECURSIVE {_inner('g4_motifs', 'SELECT o.seq_id')} SELECT seq_id, 'G-Quadruplex', round(sum(score), 4) FROM g JOIN o USING (seq_id, rn) WHERE kept GROUP BY 1)
  UNION ALL SELECT * FROM (WITH RECURSIVE {_inner('r_loop_motifs', 'SELECT o.seq_id')} SELECT seq_id, 'R-Loop', round(least(sum(riz / 100.0 + zone / 100.0), 1.0), 4) FROM g JOIN o USING (seq_id, rn) WHERE kept GROUP BY 1)
  UNION ALL SELECT * FROM (WITH RECURSIVE {_inner('imotif_motifs', 'SELECT o.seq_id')}, w AS (SELECT seq_id, sum(score * greatest(1.0, length / 10.0)) AS t FROM g JOIN o USING (seq_id, rn) WHERE kept GROUP BY 1),
    v AS (SELECT seq_id FROM dna WHERE instr(bases, 'CCCCTCCCCTCCCCTCCCC') > 0 OR instr(bases, 'CCCCACCCCACCCCACCCC') > 0)
    SELECT seq_id, 'i-Motif', round(CASE WHEN v.seq_id IS NOT NULL THEN 0.99 ELSE t END, 4) FROM w FULL JOIN v USING (seq_id))"""

_KNOWN = [("IM_VAL_001", "CCCCTCCCCTCCCCTCCCC", "GGGGAGGGGAGGGGAGGGG", "Validated i-motif sequence 1", "Gehring 1993"), ("IM_VAL_002", "CCCCACCCCACCCCACCCC", "GGGGTGGGGTGGGGTGGGG", "Validated i-motif sequence 2", "Leroy 1995")]
ORACLES["validated_i_motifs"] = f"WITH {DNA} " + " UNION ALL ".join(
    f"""SELECT seq_id, '{i}' AS id, CAST(spot AS BIGINT) AS "start", CAST(spot + 18 AS BIGINT) AS "end", CASE WHEN instr(bases, '{w}') > 0 THEN '+' ELSE '-' END AS strand, '{d}' AS description, '{c}' AS citation
  FROM (SELECT *, CASE WHEN instr(bases, '{w}') > 0 THEN instr(bases, '{w}') ELSE instr(bases, '{r}') END AS spot FROM dna) WHERE spot > 0""" for i, w, r, d, c in _KNOWN
)
ORACLES["contributing_tenmers"] = ORACLES["z_dna_regions"].rsplit("SELECT seq_id, min(pos)", 1)[0] + """SELECT seq_id, min(pos) OVER (PARTITION BY seq_id, island) AS region_start, pos AS "start", w AS tenmer, round(v, 4) AS score FROM g"""
ORACLES["contributing_tenmers"] = ORACLES["contributing_tenmers"].replace("s AS (SELECT seq_id, pos,", "s AS (SELECT seq_id, pos, w,")
ORACLES["resolve_across_classes"] = MOTIFS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
  {_greedy('m', 'score DESC, length DESC, ord, "start"').replace('"start" - 1', '"start"')}
  SELECT o.seq_id, o.class, o.subclass, o."start", o."end" FROM g JOIN o USING (seq_id, rn) WHERE kept"""
ORACLES["merge_detector_results"] = f"{MOTIFS} SELECT class AS detector, class, count(*) AS n, CAST(sum(length) AS BIGINT) AS bases FROM m GROUP BY class"
ORACLES["run_config"] = f"{MOTIFS} SELECT list_sort(list(DISTINCT class)) AS classes, count(DISTINCT seq_id) AS n_sequences, count(*) AS n_motifs FROM m"
ORACLES["score_bins"] = f"""{MOTIFS}, u AS (SELECT class, CAST(round(score * 1000000) AS BIGINT) AS v FROM m), r AS (SELECT class, min(v) AS lo, max(v) AS hi FROM u GROUP BY class)
  SELECT class, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 20)), 19) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM u JOIN r USING (class) GROUP BY 1, 2"""
ORACLES["composite_summary"] = f"""SELECT (SELECT count(*) FROM ({ORACLES['hybrid_pairs']})) AS n_hybrid, (SELECT count(*) FROM ({ORACLES['cluster_windows']})) AS n_cluster,
  (SELECT CAST(coalesce(floor(avg(l)), 0) AS BIGINT) FROM (SELECT "end" - "start" AS l FROM ({ORACLES['hybrid_pairs']}) UNION ALL SELECT "end" - "start" FROM ({ORACLES['cluster_windows']}))) AS avg_length"""
ORACLES["nearest_windows"] = f"""{MOTIFS}, q AS (SELECT seq_id, pattern_id, "start", "end", "start" + "end" AS middle FROM m),
  w AS (SELECT seq_id, min("start") AS s, min_by("end", "start") AS e, s2 AS mid FROM (SELECT *, "start" + "end" AS s2 FROM ({ORACLES['a_tract_windows']}) WHERE call) GROUP BY seq_id, s2),
  b AS (SELECT q.seq_id, q.middle, arg_min(struct_pack(s := s, e := e, mid := mid), (2 * abs(mid - q.middle) + CASE WHEN mid > q.middle THEN 1 ELSE 0 END)) AS r FROM (SELECT DISTINCT seq_id, middle FROM q) q JOIN w USING (seq_id) GROUP BY 1, 2)
  SELECT q.seq_id, pattern_id, q."start", q."end", middle, r.s AS near_start, r.e AS near_end, CAST(r.mid - middle AS DOUBLE) AS distance FROM q LEFT JOIN b USING (seq_id, middle)"""
