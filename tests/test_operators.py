"""Unit vectors, and sequential operators against plain versions over random inputs."""

import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strandlake.config import Config
from strandlake.functions import text
from strandlake.operators import base_errors, chains, clusters, contig_stats, corrections, intervals, pieces, reconcile, sampling, segments
from strandlake.operators.cigar import merged_insertions, with_cigar


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_n50(spark):
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "length long")
    assert contig_stats.n50(frame([100, 200, 300, 400, 500])).first().n50 == 400
    assert contig_stats.n50(frame([100, 200, 300, 400])).first().n50 == 300
    assert contig_stats.contig_stats(frame([]), 1, 2).first().n50 == 0
    rng = random.Random(1)
    xs = [rng.randrange(1, 50_000) for _ in range(300)]
    upto, plain = 0, None
    for x in sorted(xs, reverse=True):
        upto += x
        if plain is None and upto >= sum(xs) // 2:
            plain = x
    assert contig_stats.n50(frame(xs)).first().n50 == plain


CIGARS = [
    ("100M", 50, 100, 100, [], [], 0, 0),
    ("50M100I50M", 50, 100, 200, [(1050, 100)], [], 0, 0),
    ("50M100D50M", 50, 200, 100, [], [(1050, 100)], 0, 0),
    ("10S50M10S", 5, 50, 50, [], [], 10, 10),
    ("100M30D400M30D100M", 50, 660, 600, [], [(1100, 60)], 0, 0),
    ("100M30D600M30D100M", 50, 860, 800, [], [], 0, 0),
    ("5H10S100M", 50, 100, 100, [], [], 5, 10),
    ("*", 50, 0, 0, [], [], 0, 0),
    ("100M40I350M40I100M", 50, 550, 630, [(1100, 80)], [], 0, 0),
    ("100M120I450M120I100M", 50, 650, 890, [(1100, 120), (1550, 120)], [], 0, 0),
]


@pytest.mark.parametrize("cigar,least,ref,query,ins,dels,left,right", CIGARS)
def test_cigar(spark, cigar, least, ref, query, ins, dels, left, right):
    row = with_cigar(spark.createDataFrame([(cigar, 1000)], "cigar string, pos long"), least).first()
    assert (row.ref_len, row.query_len, row.left_clip, row.right_clip) == (ref, query, left, right)
    assert [tuple(x) for x in row.insertions] == ins
    assert [tuple(x) for x in row.deletions] == dels


SEGMENTS = [
    ([(0, 1000, 1100, 0, 300, 0, 20), (0, 1300, 1600, 0, 300, 0, 20)], [("D-segment", 800, 500, 0, 20)]),
    ([(0, 1000, 1500, 50, 400, 50, 30), (16, 1200, 5500, 50, 300, 100, 30)], [("INV-segment", 1500, 3700, 16, 30)]),
    ([(0, 1000, 1100, 0, 100, 0, 30), (16, 5000, 5100, 0, 100, 0, 30)], []),
]


@pytest.mark.parametrize("rows,expected", SEGMENTS)
def test_segments(spark, rows, expected):
    aligned = spark.createDataFrame([("r", "c", f, p, q, lc, rc, al, e - p) for f, p, e, lc, al, rc, q in rows], "qname string, rname string, flag int, pos long, mapq int, left_clip long, right_clip long, query_len long, ref_len long")
    assert [(x.sig_type, x.pos, x.size, x.flag, x.mapq) for x in segments.segment_signals(aligned).collect()] == expected


def plain_trimmed(sizes, least):
    """The slice of sorted sizes that stays when far outliers at either end are dropped, one at a time."""
    a, b = 0, len(sizes)
    while b - a > max(least - 2, 2):
        bottom, middle, top = sizes[a], sizes[a + (b - a) // 2], sizes[b - 1]
        if top > 2 * middle and top - middle > 30:
            b -= 1
        elif middle > 2 * bottom and middle - bottom > 30:
            a += 1
        else:
            break
    return a, b


def plain_one(members, support, tag="Unique"):
    """members (size, pos, mapq, read), sorted, to (pos, size, cnt, quality, reads, tag)."""
    least = max(2, support)
    a, b = plain_trimmed([m[0] for m in members], least)
    n, own = b - a, members[a:b]
    if n < least:
        return None
    return sum(m[1] for m in own) // n, sum(m[0] for m in own) // n, n, sum(m[2] for m in own) / n, [m[3] for m in own], tag


def plain_merge(members, support):
    members = sorted(members)
    n = len(members)
    if n and n >= 1.5 * support:
        upper, lower = members[3 * n // 4][0], members[n // 4][0]
        if upper > int(1.75 * lower) and upper - lower > 50:
            near = [True] * n
            for _ in range(3):
                near = [abs(m[0] - upper) <= abs(m[0] - lower) for m in members]
                sides = [[m[0] for m, x in zip(members, near) if x is side] for side in (True, False)]
                upper, lower = (sum(g) // len(g) if g else m for g, m in zip(sides, (upper, lower)))
            found = [plain_one([m for m, x in zip(members, near) if x is side], support) for side in (True, False)]
            found = [x for x in found if x]
            if found:
                return [(*x[:5], "CompoundSV") for x in found] if len(found) == 2 else found
    one = plain_one(members, support)
    return [one] if one else []


def test_plain_merge():
    member = lambda size, pos=1000: (size, pos, 30, "r")
    one = plain_merge([(200 + i, 1000 + 2 * i, 30, f"r{i}") for i in range(5)], 3)
    assert [x[:4] for x in one] == [(1004, 202, 5, 30.0)] and one[0][5] == "Unique"
    assert plain_one(sorted([member(100 + 5 * i) for i in range(5)] + [member(9999)]), 3)[1:3] == (110, 5)
    assert plain_merge([member(100)], 5) == []
    assert [x[5] for x in plain_merge([member(200)] * 6, 3)] == ["Unique"]
    two = plain_merge([member(100 + 2 * i) for i in range(5)] + [member(500 + 2 * i) for i in range(5)], 3)
    assert [(x[1], x[5]) for x in two] == [(504, "CompoundSV"), (104, "CompoundSV")]


@pytest.mark.parametrize("support", [1, 3, 7])
def test_merge(spark, support):
    """Clusters of all kinds: bimodal, with outliers, with many members of one size, tied, too small."""
    rng = random.Random(support)
    rows = []
    for k in range(300):
        kinds = rng.choice(([100], [100, 400], [60, 61, 900], [50, 5000], [200, 200, 200, 9000], [70, 150, 330]))
        for _ in range(rng.choice((1, 2, 3, 5, 12, 40))):
            size = rng.choice(kinds) + rng.choice((0, 0, 0, rng.randrange(20)))
            rows.append(("c", k, 1000 + rng.randrange(4), size, 20 + rng.randrange(3), f"r{rng.randrange(5)}"))
    frame = spark.createDataFrame(rows, "contig string, cluster long, pos long, size long, mapq int, read string")
    found = sorted((r.contig, r.pos, r.size, r.cnt, r.quality, tuple(r.reads), r.tag) for r in clusters.merged(frame, ["contig", "cluster"], support).collect())
    expected = sorted(("c", *x[:4], tuple(x[4]), x[5]) for k in range(300) for x in plain_merge([(r[3], r[2], r[4], r[5]) for r in rows if r[1] == k], support))
    assert found == expected and {x[6] for x in found} == {"Unique", "CompoundSV"}


def test_greedy_clusters(spark):
    rng = random.Random(2)
    rows = [(f"c{rng.randrange(3)}", rng.randrange(60_000)) for _ in range(400)] + [("c0", 5)] * 50
    plain, start = set(), {}
    for contig, pos in sorted(rows):
        if contig not in start or pos > start[contig] + 1600:
            start[contig] = pos
        plain.add((contig, pos, start[contig]))
    found = clusters.with_cluster(spark.createDataFrame(rows, "contig string, pos long"), ["contig"])
    assert found.count() == len(rows)
    assert {tuple(r) for r in found.select("contig", "pos", "cluster").collect()} == plain


@pytest.mark.parametrize("width", [11, 64, 1 << 16])
def test_chains_and_nearest(spark, width):
    """Chains of many steps without a gap, over ranges with and without positions."""
    rng = random.Random(width)
    points = {k: sorted({rng.randrange(3000) for _ in range(n)}) for k, n in (("a", 900), ("b", 40), ("c", 1))}
    frame = spark.createDataFrame([(k, p, rng.choice((0, 3, 9))) for k, own in points.items() for p in own], "contig string, pos long, reach long")
    reach = {(r.contig, r.pos): r.reach for r in frame.collect()}
    expected = set()
    points["d"] = [7, 8, 9, 10, 70, 71, 2000]
    frame = frame.union(spark.createDataFrame([("d", p, 9) for p in points["d"]], frame.schema))
    reach = {(r.contig, r.pos): r.reach for r in frame.collect()}
    for k, own in points.items():
        end = None
        for p in own:
            if end is None or p > end:
                start, end = p, p + reach[k, p]
            expected.add((k, p, start))
    assert {(r.contig, r.pos, r.cluster) for r in chains.with_start(frame.select("contig", "pos"), frame, ["contig"], 9, width).collect()} == expected
    asked = spark.createDataFrame([(k, q) for k in ("a", "b", "z") for q in range(0, 3100, 7)], "contig string, q long")
    for beyond in (True, False):
        for r in chains.nearest(asked, frame, ["contig"], F.col("q"), beyond, width).collect():
            own = [p for p in points.get(r.contig, []) if (p > r.q if beyond else p <= r.q)]
            assert r.near == ((min if beyond else max)(own) if own else None)


def test_greedy_members(spark):
    rows = [("c", p, 3000, 30, f"r{k}") for k, p in enumerate([1000, 1500, 2800, 1200, 6000])]
    members = clusters.with_cluster(spark.createDataFrame(rows, "contig string, pos long, size long, mapq int, read string"), ["contig"])
    one = clusters.merged(members, ["contig", "cluster"], 3).collect()
    assert [(x.pos, x.size, x.cnt, sorted(x.reads), x.tag) for x in one] == [(1233, 3000, 3, ["r0", "r1", "r3"], "Unique")]
    assert clusters.merged(members, ["contig", "cluster"], 5).collect() == []


def plain_adaptive(rows):
    """Rows (pos, size), sorted, one by one: a cluster that its first window can't extend gets a wider one and keeps it."""
    out, window, total = [], 100, 0
    for pos, size in rows:
        if out and pos > out[-1][0][0] + window and window == 100:
            mean = total // len(out[-1])
            window = 200 if mean <= 100 else 400 if mean <= 500 else 800
        if not out or pos > out[-1][0][0] + window:
            out.append([])
            window, total = 100, 0
        out[-1].append((pos, size))
        total += size
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_adaptive(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40_000), rng.choice((60, 90, 300, 700, 2000))) for _ in range(300)] + [(5, 50)] * 20
    if not seed:
        rows = [(0, 50), (100, 50), (180, 50), (201, 50), (5000, 600), (5700, 600)]
        assert [len(c) for c in plain_adaptive(rows)] == [3, 1, 2]
    found = clusters.with_adaptive_cluster(spark.createDataFrame([("c", *r) for r in rows], "contig string, pos long, size long"), ["contig"])
    assert sorted((r.pos, r.size, r.cluster) for r in found.collect()) == sorted((*r, own[0][0]) for own in plain_adaptive(sorted(rows)) for r in own)


def dense_regions(marks, length, threshold=3):
    """Regions by a depth for each position."""
    depth = [0] * length
    for a, b in marks:
        for k in range(a, b):
            depth[k] += 1
    out, start, most = [], None, 0
    for k, d in enumerate([*depth, -1]):
        if start is not None:
            if d >= max(threshold, most // 10):
                most = max(most, d)
                continue
            out.append((start, k, most))
            start = None
        elif d > threshold:
            start, most = k, d
    return out


@pytest.mark.parametrize("seed,n,deep", [(1, 60, 0), (2, 200, 60), (3, 150, 130)])
def test_depth_regions(spark, seed, n, deep):
    rng = random.Random(seed)
    marks = [(a, min(a + rng.randrange(1, 60), 999)) for a in (rng.randrange(998) for _ in range(n))] + [(400, 400 + rng.randrange(10, 40)) for _ in range(deep)]
    frame = spark.createDataFrame([("c", a, b) for a, b in marks], "contig string, m_from long, m_to long")
    found = intervals.depth_regions(intervals.depth_segments(frame, 100), width=70)
    assert sorted((r.r_from, r.r_to, r.most) for r in found.collect()) == dense_regions(marks, 1000)


def test_overlaps_and_flanks(spark):
    rng = random.Random(5)
    left = [(k, f"c{k % 2}", a, a + rng.randrange(1, 900)) for k in range(60) for a in [rng.randrange(5000)]]
    right = [(k, f"c{k % 2}", a, a + rng.randrange(1, 900)) for k in range(60) for a in [rng.randrange(5000)]]
    found = intervals.overlaps(spark.createDataFrame(left, "i long, contig string, l_from long, l_to long"), spark.createDataFrame(right, "j long, contig string, r_from long, r_to long"), 256)
    assert sorted((r.i, r.j) for r in found.collect()) == sorted((i, j) for i, c, a, b in left for j, d, x, y in right if c == d and a < y and x < b)
    events = [("c0", 500 * k, 500 * k + 100) for k in range(8)]
    reads = [("c0", rng.randrange(1, 4000), 300, 1024 if k % 5 == 0 else 0) for k in range(80)]
    out = intervals.flank_depth(spark.createDataFrame(events, "contig string, start long, end long"), spark.createDataFrame(reads, "rname string, pos long, ref_len long, flag int"), width=128)
    plain = lambda a, b: sum(1 for _, p, n, f in reads if not f and p <= b and p + n > max(a, 1)) if b >= 1 else 0
    assert {(r.start, r.depth_left, r.depth_right) for r in out.collect()} == {(s, plain(s - 99, s), plain(e + 1, e + 100)) for _, s, e in events}


@pytest.mark.parametrize("point", [True, False])
def test_small_twins(spark, point):
    rng = random.Random(9)
    rows = lambda n: [("c", rng.randrange(20_000), rng.randrange(50, 5000)) for _ in range(n)]
    large, small = rows(80), rows(80)
    frame = lambda x: spark.createDataFrame(x, "contig string, pos long, size long")
    meets = lambda a, b: min(a[1] + a[2], b[1] + (1 if point else b[2])) > max(a[1], b[1]) and 0.8 * b[2] <= a[2] <= b[2] / 0.8
    found = intervals.without_small_twin(frame(large), frame(small), point).select("contig", "pos", "size").collect()
    assert sorted(map(tuple, found)) == sorted(a for a in large if not any(meets(a, b) for b in small))


EVENT = "contig string, start long, end long, cnt long, etype string, size long, reads array<string>, tag string, depth_left long, depth_right long, depth_min long, gt string"


def event(etype, start, size, cnt, reads, left=20, right=30, contig="c"):
    return (contig, start, start + (1 if etype == "Collapse" else size), cnt, etype, size, reads, "Unique", left, right, min(left, right), "1/1")


@pytest.mark.parametrize(
    "expansion,collapse,expected",
    [
        (event("Expansion", 1000, 500, 4, list("abcd")), event("Collapse", 1100, 480, 4, list("abcd")), []),  # cancels
        (event("Expansion", 1000, 900, 4, list("abcd")), event("Collapse", 1100, 480, 4, list("abcd")), [("Expansion", [1000], 4, [420], "1/1", None)]),
        (event("Expansion", 1000, 300, 4, list("abcd")), event("Collapse", 1100, 480, 4, list("abcd")), [("Collapse", [1100], 4, [180], "1/1", None)]),
        (event("Expansion", 1000, 500, 2, list("ab")), event("Collapse", 1100, 480, 2, list("cd"), 25, 10), [("HaplotypeSwitch", [1000, 1100], 4, [500, 480], "-/-", "2;2")]),
        (event("Expansion", 1000, 500, 1, ["a"]), event("Collapse", 1100, 480, 9, list("cde")), [("Collapse", [1100], 3, [500, 480], "-/-", None)]),
        (event("Expansion", 1000, 500, 9, list("abc")), event("Collapse", 1100, 480, 1, ["d"]), [("Expansion", [1000], 3, [500, 480], "-/-", None)]),
        (event("Expansion", 1000, 500, 2, ["a", "a"]), event("Collapse", 9000, 480, 2, ["b"]), [("Collapse", [9000], 1, [480], "1/1", None), ("Expansion", [1000], 1, [500], "1/1", None)]),
    ],
)
def test_reconcile(spark, expansion, collapse, expected):
    out = reconcile.reconciled(spark.createDataFrame([expansion, collapse], EVENT)).orderBy("etype").collect()
    assert [(r.etype, r.starts, r.support, r.sizes, r.gt, r.switch) for r in out] == expected
    if expected and expected[0][0] == "HaplotypeSwitch":
        assert (out[0].depth_left, out[0].depth_right, out[0].depth_min) == (25, 30, 25)


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_greedy_match(spark, most):
    """By one fold of each part, and with rounds for all parts of more than two pairs."""
    rng = random.Random(4)
    rows = [event("Expansion", rng.randrange(30_000), rng.randrange(50, 600), 3, ["a"]) for _ in range(60)]
    rows += [event("Collapse", rng.randrange(30_000), rng.randrange(20, 600), 3, ["b"]) for _ in range(60)]
    numbered = reconcile.numbered(spark.createDataFrame(rows, EVENT))
    found = {(r.e_ord, r.c_ord) for r in reconcile.matched(reconcile.candidates(numbered), most).collect()}
    narrow = {(r.etype, r.start, r.size): r.ord for r in reconcile.numbered(spark.createDataFrame(rows, EVENT), 100).collect()}
    assert narrow == {(r.etype, r.start, r.size): r.ord for r in numbered.collect()}
    kinds = {k: sorted(r.asDict()["ord"] for r in numbered.where(F.col("etype") == k).collect()) for k in ("Expansion", "Collapse")}
    row = {(r.etype, r.ord): r for r in numbered.collect()}
    free, plain = list(kinds["Collapse"]), set()
    for e in kinds["Expansion"]:
        x = row["Expansion", e]
        for c in free:
            y = row["Collapse", c]
            if x.start - 250 <= y.start <= x.end + 250 and x.size < 20 * y.size:
                plain.add((e, c))
                free.remove(c)
                break
    assert found == plain and len(plain) > 10


@pytest.mark.parametrize("fraction,block", [(0.3, 50), (0.9, 7), (0.05, 1000), (0.0, 9), (1.0, 9)])
def test_within_budget(spark, fraction, block):
    """Against the rule read by read: blocks that meet their guess, and blocks too short for that."""
    rng = random.Random(block)
    bases = [rng.choice((0, 1, 50, rng.randrange(1, 9000))) for _ in range(700)]
    frame = spark.createDataFrame([(f"r{k}", n) for k, n in enumerate(bases)], "name string, bases long").withColumn("at", F.substring("name", 2, 9).cast("long"))
    reads = sampling.with_number(frame, ["at"], F.col("at"), 64)
    written, total, kept = 0, 0, []
    for k, n in enumerate(bases):
        total += n
        if written < math.floor(total * fraction) or fraction == 1:
            written += n
            kept.append(k)
    found = sampling.within_budget(reads, fraction, block).collect()
    assert sorted((r.turn, r.number, r["name"], r.bases) for r in found) == [(j, k, f"r{k}", bases[k]) for j, k in enumerate(kept)]


def test_budget_rounds(spark, monkeypatch):
    """Runs that meet late take few rounds: neighbouring blocks are folded together, in ever larger groups."""
    rng = random.Random(8)
    lengths = [rng.randrange(1, 1_000_000) for _ in range(3000)]
    reads = spark.createDataFrame(list(enumerate(lengths)), "number long, bases long").repartition(3)
    rounds, forgotten = [], sampling.forgotten
    monkeypatch.setattr(sampling, "forgotten", lambda *x: rounds.append(1) or forgotten(*x))
    found = sampling.within_budget(reads, 0.3, 20).orderBy("number").collect()
    keep = sampling.kept_run(lengths, 0, 0, 0.3)[1]
    assert [r.number for r in found] == [k for k in range(3000) if keep[k]] and [r.turn for r in found] == list(range(len(found)))
    assert len(rounds) <= 9  # of 150 blocks



def test_final_filter(spark):
    rows = [("c", [1], [2], s, "Inversion", [z], "1/1", 20, 20, d, "r", None) for s, z, d in ((10, 60, 12), (9, 60, 12), (10, 40, 12), (10, 60, 15), (30, 60, 9), (40, 60, 40))]
    schema = "contig string, starts array<long>, ends array<long>, support long, etype string, sizes array<long>, gt string, depth_left long, depth_right long, depth_min long, reads string, switch string"
    out = reconcile.final_events(spark.createDataFrame(rows, schema), 20)
    assert [(r.support, r.depth_min) for r in out.collect()] == [(10, 12)]
    assert reconcile.structural_summary(out).first().error_bases == 200


def test_pileup_text(spark):
    assert value(spark, text.normalized_pileup(F.lit(".,aA^]tTcCgG"))) == "..AATTCCGG"
    bases = F.lit(".+5AACGT-2TT+1A")
    assert value(spark, text.indel_sequences(bases, "+")) == ["AACGT", "A"]
    assert value(spark, text.indel_sequences(bases, "-")) == ["TT"]
    assert value(spark, text.most_frequent(F.array(F.lit("TT"), F.lit("A")))) == "TT"
    assert value(spark, text.most_frequent(F.array().cast("array<string>"))) is None
    assert value(spark, F.round(text.binomial_tail(F.lit(7).cast("long"), F.lit(10).cast("long"), 0.4), 10)) == 0.0547618816
    assert value(spark, text.binomial_tail(F.lit(12).cast("long"), F.lit(10).cast("long"), 0.4)) == 0.0
    assert value(spark, text.reverse_complement(F.lit("ATCGaN"))) == "NTCGAT"


def test_base_candidates(spark):
    rows = [("c", 5, "A", 10, ".....TTTTt"), ("c", 6, "A", 10, ".+2AC" * 8 + ".."), ("c", 7, "A", 10, ".-1g" * 6 + "...."), ("c", 8, "N", 10, "T" * 10), ("c", 9, "A", 10, "*" * 10), ("c", 10, "A", 3, "TTT")]
    frame = spark.createDataFrame(rows, "contig string, pos long, ref string, depth long, bases string").withColumns({"mincount": F.lit(4).cast("long"), "maxcov": F.lit(20).cast("long")})
    found = base_errors.candidates(frame, 2).orderBy("start").collect()
    assert [(r.start, r.end, r.etype, r.size, r.support, r.depth) for r in found] == [(4, 5, "SNP", 1, 5, 10), (5, 6, "insertion", 2, 8, 10), (6, 7, "deletion", 1, 6, 10)]
    assert base_errors.valid_bases(frame, 2).first().valid_bases == 5
    kept = base_errors.significant(base_errors.candidates(frame, 2), Config()).collect()
    assert {r.etype for r in kept} == {"insertion"} and base_errors.error_counts(base_errors.candidates(frame, 2)).first().n_substitution == 1


def test_native_pileup(spark):
    reads = [("c", 1, 0, 60, "4M", "ACGT"), ("c", 2, 0, 60, "1M1D2M", "CTA"), ("c", 1, 256, 60, "4M", "TTTT"), ("c", 1, 0, 5, "4M", "TTTT"), ("c", 1, 2048, 60, "1S2M1I1M", "GACTG")]
    frame = spark.createDataFrame(reads, "rname string, pos long, flag int, mapq int, cigar string, seq string")
    out = base_errors.native_pileup(frame, spark.createDataFrame([("c", "ACGTA")], "name string, sequence string"), width=2)
    assert [(r.pos, r.ref, r.depth, r.bases) for r in out.orderBy("pos").collect()] == [(1, "A", 2, ".."), (2, "C", 3, "...+1T-1N"), (3, "G", 3, "*.."), (4, "T", 2, ".."), (5, "A", 1, ".")]


def plain_pileup(reads, contigs):
    """Each base on its own."""
    found = {}
    for name, pos, flag, mapq, cigar, seq in reads:
        if flag & 1796 or mapq < 20:
            continue
        at, q = pos, 0
        for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
            if op in "ID" and at > pos:
                found.setdefault((name, at - 1), []).append(f"+{n}{seq[q:q + n].upper()}" if op == "I" else f"-{n}{'N' * n}")
            for k in range(n if op in "M=XD" else 0):
                found.setdefault((name, at + k), []).append("*" if op == "D" else seq[q + k].upper())
            at += n if op in "M=XDN" else 0
            q += n if op in "M=XIS" else 0
    out = []
    for (name, pos), bases in found.items():
        ref = contigs[name][pos - 1 : pos].upper()
        bases.sort(key=lambda b: (len(b), b))
        depth = sum(len(b) == 1 for b in bases)
        if depth:
            out.append((name, pos, ref, depth, "".join("." if b == ref else b for b in bases)))
    return sorted(out)


@pytest.mark.parametrize("width", [4096, 100])
def test_pileup_of_long_reads(spark, width):
    """Reads of some kilobases with all kinds of steps, over borders of pieces, on small letters and N."""
    rng = random.Random(8)
    contigs = {f"c{k}": "".join(rng.choices("ACGTacgN", k=12_000)) for k in range(2)}
    reads = []
    for k in range(40):
        name, pos = rng.choice(list(contigs)), rng.randrange(1, 9000)
        at, cigar, seq = pos - 1, ["5S"], ["TTTTT"]
        stop = min(pos + rng.choice((50, 9000)), 11_900)
        while at < stop:
            op, n = rng.choice("MMM=XIDN"), rng.choice((1, 3, 40, 300))
            if op in "M=X":
                own = list(contigs[name][at : at + n])
                for j in range(0, len(own), 17):
                    own[j] = rng.choice("ACGT")
                n = len(own)
                seq.append("".join(own))
            elif op == "I":
                seq.append("".join(rng.choices("ACGT", k=n)))
            at += n if op != "I" else 0
            cigar.append(f"{n}{op}")
        reads.append((name, pos, rng.choice((0, 16, 2048, 1024)), rng.choice((60, 60, 10)), "".join(cigar), "".join(seq)))
    reads += reads[:5]
    frame = spark.createDataFrame([*reads, ("c0", 5, 0, 60, "*", "*"), ("c1", 9, 0, 60, "4M", "*"), ("c0", None, 0, 60, "4M", "ACGT"), ("gone", 1, 0, 60, "4M", "ACGT")], "rname string, pos long, flag int, mapq int, cigar string, seq string")
    out = base_errors.native_pileup(frame, spark.createDataFrame(list(contigs.items()), "name string, sequence string"), width=width)
    found = sorted(map(tuple, out.collect()))
    expected = [x for x in plain_pileup(reads, contigs) if x[2]]
    assert found == expected and len(found) > 10_000


def test_indels_of_native_pileup(spark):
    """Insertions and deletions are called from a pileup made here; one at a read's start has no column."""
    reads = [("c", 1, 0, 60, "3M2I3M", "ACGTTTAC")] * 5 + [("c", 1, 0, 60, "2M1D3M", "ACTAC")] * 4 + [("c", 2, 0, 60, "2I3M", "GGCGT")]
    frame = spark.createDataFrame(reads, "rname string, pos long, flag int, mapq int, cigar string, seq string")
    pileup = base_errors.native_pileup(frame, spark.createDataFrame([("c", "ACGTAC")], "name string, sequence string"))
    rows = pileup.withColumns({"mincount": F.lit(4).cast("long"), "maxcov": F.lit(20).cast("long")})
    found = base_errors.candidates(rows, 2).orderBy("start", "etype").collect()
    assert [(r.start, r.end, r.etype, r.size, r.support) for r in found] == [(1, 2, "deletion", 1, 4), (2, 3, "insertion", 2, 5)]


def test_insertions_are_the_plain_ones(spark):
    """Joined from the right, with a new look at all of them after each join."""
    rng = random.Random(14)
    rows = []
    for _ in range(300):
        at, own = 0, []
        for _ in range(rng.randrange(9)):
            at += rng.choice((100, 390, 410, 590, 610, 900))
            own.append((at, rng.choice((10, 60, 120, 450, 600))))
        rows.append(own)

    def plain(items):
        items, k = list(items), len(items) - 1
        while k > 0:
            most = max(items[k][1], items[k - 1][1])
            if items[k][0] - items[k - 1][0] <= (400 if 100 <= most < 500 else 600):
                items[k - 1 : k + 1] = [(items[k - 1][0], items[k - 1][1] + items[k][1])]
                k = len(items)
            k -= 1
        return items

    frame = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, ins array<struct<pos:bigint,len:bigint>>")
    found = frame.select("k", merged_insertions(F.col("ins")).alias("x")).orderBy("k").collect()
    assert [[tuple(i) for i in r.x] for r in found] == [plain(x) for x in rows]


def plain_patch(s, edits, structural):
    """Edits one by one, each on a whole new string."""
    turn = str.maketrans("ACGTacgt", "TGCATGCA")
    for start, end, kind, size in sorted(edits, reverse=True):
        n, inside = len(s), start <= end
        if start >= n:
            continue
        if kind == "DEL":
            if not structural:
                s = s[:start] + "N" * size + s[start:]
            elif inside:
                s = s[:start] + "N" * min(size, end - start) + s[end:]
        elif kind == "INS" and inside and end < n:
            s = s[:start] + s[end:]
        elif kind == "SNP" and not structural:
            s = s[:start] + "N" + s[start + 1 :]
        elif kind == "INV" and structural and inside and end <= n:
            s = s[:start] + s[start:end][::-1].translate(turn) + s[end:]
    return s


@pytest.mark.parametrize("width", [1 << 20, 7])
def test_many_edits(spark, width):
    """Touching, overlapping, tied and out-of-range edits of long sequences, base edits before structural ones; contigs in one
    piece, and in pieces that are shorter than most edits."""
    rng = random.Random(15)
    schema = "chrom string, start long, end long, sv_type string, size long"
    contigs = [(f"c{k}", "".join(rng.choice("ACGT") for _ in range(rng.choice((0, 5, 300))))) for k in range(40)]
    edits = {}
    for side in (False, True):
        edits[side] = [(c, at, at + rng.randrange(-1, 30), rng.choice(("SNP", "INS", "DEL", "INV", "x")), rng.randrange(20)) for c, s in contigs[:-3] for at in (rng.randrange(len(s) + 5) for _ in range(12))]
    out = corrections.corrected(spark.createDataFrame(contigs, "name string, sequence string"), *(spark.createDataFrame(edits[x], schema) for x in (False, True)), width)
    own = lambda c, side: [e[1:] for e in edits[side] if e[0] == c]
    assert {r.name: r.sequence for r in out.collect()} == {c: plain_patch(plain_patch(s, own(c, False), False), own(c, True), True) for c, s in contigs}


@pytest.mark.parametrize(
    "sequence,kind,edits,expected",
    [
        ("ACGTACGT", "base", [(2, 3, "SNP", 1)], "ACNTACGT"),
        ("ACGTACGT", "base", [(2, 5, "INS", 3)], "ACCGT"),
        ("ACGTACGT", "base", [(2, 2, "DEL", 2)], "ACNNGTACGT"),
        ("ACGTACGTACGT", "structural", [(4, 8, "DEL", 4)], "ACGTNNNNACGT"),
        ("ACGATACGT", "structural", [(2, 7, "INV", 5)], "ACGTATCGT"),
        ("ACGTACGTACGTACGT", "base", [(12, 14, "INS", 2), (4, 5, "SNP", 1)], "ACGTNCGTACGTGT"),
        ("ACGT", "base", [(9, 10, "SNP", 1), (0, 1, "other", 1)], "ACGT"),
        ("ACGT", "base", [(4, 4, "DEL", 3)], "ACGT"),
        ("ACGT", "base", [(3, 3, "DEL", 3)], "ACGNNNT"),
        ("ACGT", "structural", [(2, 4, "INS", 2)], "ACGT"),
        ("ACGT", "structural", [(2, 4, "INV", 2)], "ACAC"),
        ("ACGT", "structural", [(2, 9, "DEL", 9)], "ACNNNNNNN"),
        ("ACGT", "base", [], "ACGT"),
    ],
)
def test_corrections(spark, sequence, kind, edits, expected):
    schema = "chrom string, start long, end long, sv_type string, size long"
    own, none = spark.createDataFrame([("c", *e) for e in edits], schema), spark.createDataFrame([], schema)
    contigs = spark.createDataFrame([("c", sequence), ("other", "AC")], "name string, sequence string")
    out = corrections.corrected(contigs, *((own, none) if kind == "base" else (none, own)))
    assert {r.name: r.sequence for r in out.collect()} == {"c": expected, "other": "AC"}


def test_groups_of_edits(spark):
    """No island of a group reaches into the next group; groups are of single ranges where nothing reaches over."""
    rng = random.Random(12)
    rows = [("c", at, at + rng.choice((0, 1, 3, 12))) for at in rng.sample(range(1500), 160)] + [("d", 5, 400), ("d", 399, 399), ("d", 500, 501)]
    found = pieces.with_group(spark.createDataFrame(rows, "chrom string, start long, end long"), 20).collect()
    for c in ("c", "d"):
        own = sorted((r.start, r.end, r["group"]) for r in found if r.chrom == c)
        cut = list(pieces.islands(iter(own)))
        assert all(len({e[2] for e in island}) == 1 for island in cut)
        ranges = {}
        for island in cut:
            ranges.setdefault(island[0][2], []).extend(e[0] // 20 for e in island)
        assert len(ranges) > (15 if c == "c" else 1)
    assert len(found) == len(rows)


def test_few_edits_of_many_pieces(spark):
    """Single edits far apart, also over borders of pieces, in contigs of small and capital letters; N runs longer than a piece."""
    rng = random.Random(4)
    schema = "chrom string, start long, end long, sv_type string, size long"
    contigs = [(f"c{k}", "".join(rng.choice("ACGTacgtN") for _ in range(2000))) for k in range(6)]
    base, structural = ([(c, at, at + n, kind, m) for c, _ in contigs[1:] for at in rng.sample(range(2000), 9) for n, m, kind in [(rng.choice((0, 1, 40)), rng.choice((1, 5, 90)), rng.choice(kinds))]] for kinds in (("SNP", "INS", "DEL"), ("INV", "INS", "DEL", "INV")))
    cut = pieces.pieces_of(spark.createDataFrame(contigs, "name string, sequence string"), 32)
    assert cut.count() == 6 * 63
    out = corrections.corrected_pieces(cut, spark.createDataFrame(base, schema), spark.createDataFrame(structural, schema), 32)
    rows = out.collect()
    assert all(r.offset == 32 * r.piece and 0 < len(r.text) <= 32 for r in rows)
    own = lambda c, edits: [e[1:] for e in edits if e[0] == c]
    expected = {c: plain_patch(plain_patch(s, own(c, base), False), own(c, structural), True) for c, s in contigs}
    found = {r.name: r.sequence for r in pieces.whole(out).collect()}
    assert found == expected
    assert sum(len(s) // 32 + (len(s) % 32 > 0) for s in expected.values()) == len(rows)


def test_deep_binomial_tails(spark):
    """Against exact fractions, where products of doubles underflow too."""
    cases = [(k, n, p) for n in (1, 5, 20, 60, 400) for k in {0, 1, 2, n // 2, n - 1, n, n + 1} for p in (0.4, 0.5)]
    cases += [(900, 1200, 0.5), (1000, 1500, 0.4), (1500, 2000, 0.5), (500, 1200, 0.4), (480, 1200, 0.4), (450, 1200, 0.4), (20_000, 40_000, 0.5), (19_900, 40_000, 0.5), (16_100, 40_000, 0.4), (3, 40_000, 0.4)]
    for p in (0.4, 0.5):
        own = [(k, n) for k, n, x in cases if x == p]
        found = spark.createDataFrame(own, "k long, n long").select("k", "n", text.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()
        for k, n, t in found:
            a, b = {0.4: (2, 5), 0.5: (1, 2)}[p]
            last = max(k - 1, 0)
            exact = 0.0 if last >= n else float(Fraction(sum(math.comb(n, i) * a**i * (b - a) ** (n - i) for i in range(last + 1, n + 1)), b**n)) if n < 3000 else None
            if exact is None:  # sums of 40,000 large numbers take too long: by logarithms
                exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(last + 1, n + 1))
            assert abs(t - exact) < 1e-9, (k, n, p)


def test_most_frequent(spark):
    rng = random.Random(2)
    rows = [[rng.choice(["A", "AC", "G", "T", ""]) for _ in range(rng.randrange(12))] for _ in range(60)]
    found = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v array<string>").select("k", text.most_frequent(F.col("v")).alias("x")).orderBy("k").collect()
    assert [r.x for r in found] == [max(r, key=lambda x: (r.count(x), -r.index(x))) if r else None for r in rows]


def test_corrected_bases(spark):
    schema = "start long, end long, size long"
    base, structural = spark.createDataFrame([(0, 10, 1), (50, 60, 1)], schema), spark.createDataFrame([(0, 1, -100)], schema)
    assert corrections.corrected_bases(base, structural).first().corrected_bases == 120


def test_config():
    assert Config("hifi").preset == "map-hifi" and Config().preset == "lr:hq"
    with pytest.raises(ValueError):
        Config("nanopore")


def test_pieces_are_cut_in_one_step(spark):
    """What stays of a piece and what its cuts show are made where the piece is: no row a gap is shuffled."""
    cut = pieces.pieces_of(spark.createDataFrame([("c", "ACGTTGCA" * 9)], "name string, sequence string"), 16)
    edits = spark.createDataFrame([("c", 3, 9, "INV", 6), ("c", 20, 23, "INS", 3), ("c", 47, 50, "DEL", 2)], "chrom string, start long, end long, sv_type string, size long")
    out = pieces.patched(cut, edits, True, 16)
    assert pieces.whole(out).first().sequence == pieces.mended("ACGTTGCA" * 9, [(3, 9, "INV", 6), (20, 23, "INS", 3), (47, 50, "DEL", 2)], True)
    assert all(len(r.text) == 16 and r.offset == 16 * r.piece for r in out.collect() if r.piece < 4)
    assert "filter(transform(sequence(" not in out._jdf.queryExecution().analyzed().toString()


def test_segments_pair_without_a_join(spark):
    schema = "qname string, rname string, ord int, pos long"
    rows = [(q, r, k, 10 * k) for q, r, n in (("a", "c", 4), ("a", "d", 1), ("b", "c", 3), (None, "c", 2)) for k in range(n)]
    found = segments.pairs(spark.createDataFrame(rows, schema))
    assert sorted((x.qname, x.rname, x.l_pos, x.r_pos) for x in found.collect()) == sorted((q, r, 10 * k, 10 * j) for q, r, n in (("a", "c", 4), ("b", "c", 3)) for j in range(n) for k in range(j))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
