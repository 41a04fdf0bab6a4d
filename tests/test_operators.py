import itertools
import random
from fractions import Fraction
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicon
from tidemark.functions import text as tx
from tidemark.functions import timecode as tc
from tidemark.operators import intervals as iv
from tidemark.operators import audio, boundaries, match, records, recovery, segment, signal


def frame(spark, rows, kind="stream long, id long, s long, e long"):
    return spark.createDataFrame(rows, kind)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("rows, gap, inclusive, expected", [([(0, 100), (400, 500)], 300, False, [(0, 100), (400, 500)]), ([(0, 100), (399, 500)], 300, False, [(0, 500)]), ([(0, 100), (100, 200)], 0, True, [(0, 200)]), ([(0, 100), (101, 200)], 0, True, [(0, 100), (101, 200)])])
def test_merge_edges(spark, rows, gap, inclusive, expected):
    df = frame(spark, [(1, i, s, e) for i, (s, e) in enumerate(rows)])
    assert sorted((r.s, r.e) for r in iv.merge(df, gap, inclusive).collect()) == expected


def test_unclaimed_edges(spark):
    region, claims = frame(spark, [(1, 0, 0, 100)]), frame(spark, [(1, 1, 10, 20), (1, 2, 40, 60)])
    assert [(r.s, r.e) for r in iv.unclaimed_edges(region, claims, 40).collect()] == [(60, 100)]
    assert iv.unclaimed_edges(region, claims, 41).count() == 0


def test_split(spark):
    assert sorted((r.s, r.e) for r in iv.split_max(frame(spark, [(1, 0, 0, 70)]), 30).collect()) == [(0, 30), (30, 60), (60, 70)]


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(4)
    made = lambda n: [(rng.randrange(3), i, s, s + rng.randrange(1, 400_000)) for i in range(n) for s in [rng.randrange(900_000)]]
    a, b = made(60), made(60)
    got = sorted((r.l_id, r.r_id) for r in iv.overlap_join(frame(spark, a), frame(spark, b)).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def test_snap_equals_fold(spark):
    rng = random.Random(5)
    rows = [(1, i, s, s + rng.randrange(0, 900)) for i, s in enumerate(sorted(rng.randrange(60_000) for _ in range(200)))]
    got = {r.id: (r.start_frame, r.end_frame) for r in iv.snap(frame(spark, rows), 24000, 1001).collect()}
    before, rate = -1, Fraction(24000, 1001)
    for _, i, s, e in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        a = floor(Fraction(s, 1000) * rate)
        a = a if before < 0 else max(a, before)
        before = max(ceil(Fraction(e, 1000) * rate), a + 1)
        assert got[i] == (a, before)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert iv.merge(none, 5).count() == iv.unclaimed(none, none).count() == iv.snap(none, 25).count() == 0


def test_smoothing(spark):
    track = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 1, 1])], "stream string, frame long, p double")
    assert [round(r.smooth, 6) for r in signal.smooth_causal(track, 5).orderBy("frame").collect()] == [0.2, 0.4, 0.6]
    track = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 3, 3])], "stream string, frame long, p double")
    assert [round(r.smooth, 6) for r in signal.smooth_centered(track, 3).orderBy("frame").collect()] == [1, 2, 3]


def test_smoothing_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(signal, "BLOCK", 7)
    rng = random.Random(1)
    p = [rng.random() for _ in range(50)]
    track = spark.createDataFrame([("a", i, v) for i, v in enumerate(p)], "stream string, frame long, p double")
    causal = [r.smooth for r in signal.smooth_causal(track, 5).orderBy("frame").collect()]
    assert causal == pytest.approx([sum(p[max(0, i - 4) : i + 1]) / 5 for i in range(50)])
    wide = [p[0]] * 2 + p + [p[-1]] * 2
    assert [r.smooth for r in signal.smooth_centered(track, 5).orderBy("frame").collect()] == pytest.approx([sum(wide[i : i + 5]) / 5 for i in range(50)])


@pytest.mark.parametrize("flags, expected", [("1110001", [(0, 3)]), ("1111000", [(0, 4)]), ("11011011", []), ("000", [])])
def test_hysteresis_cases(spark, flags, expected):
    track = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(flags)], "stream string, frame long, smooth double")
    got = [(r.start, r.end) for r in signal.hysteresis(track, 0.5, 2, 3, 0).collect()]
    assert got == expected == [(r.start, r.end) for r in signal.hysteresis_limited(track, 0.5, 2, 3, 0, 1000).collect()]


def test_hysteresis_window_equals_fold(spark):
    rng = random.Random(9)
    rows = [(str(k), i, float(rng.random() < 0.5)) for k in range(20) for i in range(120)]
    track = spark.createDataFrame(rows, "stream string, frame long, smooth double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(signal.hysteresis(track, 0.5, 2, 3, 1)) == rows(signal.hysteresis_limited(track, 0.5, 2, 3, 1, 10**6))


def test_windows_cover_their_stream(spark):
    rng = random.Random(3)
    cuts = spark.createDataFrame([("a", c, 3, 0.2, 0.3) for c in sorted(rng.sample(range(2000), 60))], "stream string, center long, width long, mean double, p95 double")
    ends = spark.createDataFrame([("a", 2000), ("b", 30), ("c", 500)], "stream string, total long")
    for stream, total in (("a", 2000), ("b", 30), ("c", 500)):
        w = [(r.core_start, r.core_end) for r in signal.plan_windows(ends, cuts, 45, 60, 90, 15, 2, 1.0).where(F.col("stream") == stream).orderBy("idx").collect()]
        assert w[0][0] == 0 and w[-1][1] == total and all(a[1] == b[0] for a, b in zip(w, w[1:])) and all(e - s <= 105 for s, e in w)


def test_timestamps(spark):
    assert one(spark, tc.srt_timestamp(F.lit(0.0005))) == "00:00:00,000"
    assert one(spark, tc.srt_timestamp_half_up(F.lit(0.0005))) == "00:00:00,001"
    assert one(spark, tc.srt_timestamp(F.lit(360_000.0))) == "100:00:00,000"
    assert one(spark, tc.timecode(F.lit(1800), 30, drop=True)) == "00:01:00;02"
    assert tc.parse_rate("29.97 DF") == (30000, 1001) == tc.parse_rate("30000/1001")
    with pytest.raises(ValueError):
        tc.parse_rate("31")


def test_text(spark):
    assert tx.normalize_value("Straße-ＡＢ１") == "strasseab1"
    assert one(spark, tx.collapse_closing(F.lit("。,"))) == "。" and one(spark, tx.collapse_closing(F.lit(",。"))) == ",。"
    assert one(spark, tx.trim_end_punctuation(F.lit("Fin.)  !"))) == "Fin"
    assert one(spark, tx.occurrences(F.lit("aaaa"), "aa")) == 3 and one(spark, tx.replacements(F.lit("aaaa"), "aa")) == 2
    assert one(spark, tx.version_newer(F.lit("v1.2.10"), F.lit("1.2.9"))) and not one(spark, tx.version_newer(F.lit("1.2"), F.lit("1.0.0")))
    items = lambda n: F.array_repeat(F.lit("x"), 0) if not n else F.flatten(F.array_repeat(F.array(F.lit("a"), F.lit("b")), n))
    assert one(spark, tx.repeated_suffix(items(20))) and not one(spark, tx.repeated_suffix(items(19)))
    assert one(spark, tx.abnormal(F.lit(" Transcript: "))) and one(spark, tx.abnormal(F.lit("ha " * 60))) and not one(spark, tx.abnormal(F.lit("a few plain words")))
    assert tx.width_value("漢字ab") == 6 and tx.width_value("é́\n") == 1


def stream_of(words, lang="en", pauses=(), acoustic=None):
    starts, at = [], 0
    for i in range(len(words)):
        starts.append(at)
        at += 400 + dict(pauses).get(i, 0)
    return boundaries.Stream(words, starts, [s + 350 for s in starts], lang, acoustic)


def test_region_cuts_are_the_best_of_all(spark):
    assert [segment.fragment_units(n) for n in (2, 12, 42)] == [1, 4, 8]
    assert segment.fill_score(21, 42) == 10
    rng = random.Random(2)
    vocabulary = ["the", "and", "because", "of", "house.", "rain,", "(so", "on)", "in", "order", "to", "extraordinary", "3.", "5", "percent", "go", "«a", "b»"]
    for trial in range(150):
        n, width = rng.randrange(1, 9), rng.choice([8, 12, 20])
        s = stream_of([rng.choice(vocabulary) for _ in range(n)], pauses=[(i, rng.choice([0, 0, 400, 900])) for i in range(n)])
        tiny = segment.fragment_units(width)
        short = max(tiny, round(width * 0.35))
        places = [i for i in range(1, n) if s.safe[i]]

        def total(cuts):
            score = 0
            for a, b in zip([0, *cuts], [*cuts, n]):
                units = s.units(a, b)
                over = units > width
                if over and any(a < p < b for p in places):
                    return None
                score += (0 if over else segment.fill_score(units, width)) - 500 - (60 if units < short and n > 1 else 0)
                score += s.worth(b, 0, n, width, tiny) if b < n else -(220 if units < tiny and n > 1 else 0)
            return score, -len(cuts), (*cuts, n)

        best = max(t for k in range(len(places) + 1) for c in itertools.combinations(places, k) if (t := total(c)) is not None)
        assert tuple(segment.cut_region(s, 0, n, width)) == best[2], (trial, s.texts)


def test_blocks_keep_every_token_and_fit():
    rng = random.Random(5)
    for lang, words in (("en", ["the", "end.", "a", "(b)", "because", "of", "wide-eyed", "$3.50"]), ("ja", ["東京", "で", "は", "A", "B", "3.", "5", "雨。", "test"]), ("ko", ["비가", "오지만", "나는", "간다."])):
        for _ in range(40):
            n = rng.randrange(1, 60)
            heard = [rng.choice([0, 0, 0, 350, 900, 3200]) for _ in range(n)]
            s = stream_of([rng.choice(words) for _ in range(n)], lang, [(i, rng.choice([0, 0, 0, 900, 3300])) for i in range(n)], heard)
            blocks = segment.segmented(s, 14)
            assert "".join(t for _, _, t in blocks).replace(" ", "") == s.rendered.replace(" ", "")
            assert all(tx.width_value(t) <= 14 for _, _, t in blocks) and [b[0] for b in blocks] == sorted(b[0] for b in blocks)
            for i in range(1, n):
                if s.acoustic[i] >= 3000:
                    assert any(b[0] == s.starts[i] for b in blocks)


def test_regions_end_at_pauses_but_not_at_orphans():
    words = "we went to the old house and then it rained".split()
    assert segment.region_end(stream_of(words, pauses=[(5, 1600)]), 0, 42) == 6
    assert segment.region_end(stream_of(words, pauses=[(3, 1600)]), 0, 42) == len(words)  # "the" holds on to what follows
    quiet = lambda i, ms: [ms if k == i else 0 for k in range(len(words))]
    assert segment.region_end(stream_of(words, acoustic=quiet(6, 400)), 0, 42) == 6  # before "and"
    assert segment.region_end(stream_of(words, acoustic=quiet(9, 400)), 0, 42) == len(words)
    assert segment.region_end(stream_of(words, acoustic=quiet(9, 900)), 0, 42) == 9
    assert segment.region_end(stream_of(["a", *words], acoustic=[0, 900] + [0] * 9), 0, 42) == 11  # one letter alone
    assert segment.region_end(stream_of(words, acoustic=quiet(4, 3000)), 0, 42) == 4
    assert segment.region_end(stream_of(["It", "rained.", *words]), 0, 42) == 2


def test_phrases_wildcards_and_korean_endings():
    f = stream_of("x 뿐만 아니라 y".split(), "ko").features
    assert f["matched_boundary"].tolist() == ["*뿐만 아니라", "", ""] and f["protected_phrase"].tolist() == [False, True, False]
    f = stream_of("그렇뿐만 아니라 오지만 간다".split(), "ko").features
    assert f["protected_phrase"].tolist() == [True, False, False] and f["matched_boundary"].tolist()[2] == "오지만"
    f = stream_of("x in order to go".split()).features
    assert f["matched_boundary"].tolist() == ["in order to", "", "", ""] and f["protected_phrase"].tolist() == [False, True, True, False]
    assert boundaries.reason_names(int(stream_of(["10", "percent"]).features["reasons"][0])) == ["protected_right", "number_unit"]
    assert {p.code for p in lexicon.PROFILES.values()} == set("zh yue en fr de it ja ko pt ru es".split())
    with pytest.raises(ValueError):
        stream_of(["a"], "xx")


def test_overlapping_blocks_join():
    join = lambda rows, width=42: segment.coalesced(rows, "en", width)
    assert join([(0, 1000, "a"), (500, 900, "b"), (1000, 2000, "c")]) == [(0, 1000, "a b"), (1000, 2000, "c")]
    assert join([(0, 1000, "one."), (500, 900, "b"), (1000, 2000, "c")]) == [(0, 1000, "one."), (500, 2000, "b c")]
    assert join([(0, 1000, "a long one"), (500, 900, "b"), (1000, 2000, "c")], 10) == [(0, 1000, "a long one"), (500, 2000, "b c")]
    assert join([(0, 9, "one."), (0, 9, "two")]) == [(0, 9, "one. two")]
    assert join([(0, 1000, "one."), (500, 900, "b"), (1300, 2000, "c")]) == [(0, 1000, "one."), (500, 900, "b"), (1300, 2000, "c")]
    assert segment.trimmed("so (it) was …!\u3000") == "so (it) was"


def test_reconcile(spark):
    cols = "stream long, norm string, id long, win long, s double, e double, in_s double, in_e double, coverage double"
    rows = [(1, "a", 1, 0, 0.0, 1.0, -1.0, 9.0, 1.0), (1, "a", 2, 1, 0.5, 1.5, -3.0, 9.0, 1.0), (1, "a", 3, 1, 5.0, 6.0, 0.0, 9.0, 1.0), (1, "", 4, 1, 5.0, 6.0, 0.0, 9.0, 1.0)]
    assert sorted(r.id for r in match.reconcile(spark.createDataFrame(rows, cols)).collect()) == [2, 3, 4]


def repaired(spark, rows, end=1.0):
    df = spark.createDataFrame([(1, i, t, float(a), float(b), 0.0, float(end)) for i, (t, a, b) in enumerate(rows)], "stream long, ord long, text string, start double, end double, in_s double, in_e double")
    got = match.repaired(df).orderBy("ord").collect()
    return got[0].fault or [(round(r.start, 3), round(r.end, 3)) for r in got]


def test_repair(spark):
    assert repaired(spark, [("a", 0, 0), ("b", 0.3, 0.5), ("c", 0.5, 0.5)]) == [(0, 0.08), (0.3, 0.5), (0.5, 0.58)]
    assert repaired(spark, [("a", 0.1, 0.1), ("b", 0.14, 0.5), ("c", 1.0, 1.0)]) == [(0.1, 0.14), (0.14, 0.5), (0.92, 1.0)]
    assert repaired(spark, [("a", 0.1, 0.1), ("b", 0.1, 0.13)]) == [(0.1, 0.13), (0.1, 0.13)]
    assert repaired(spark, [("a", -0.1, 0.2), ("b", 0.2, 1.1)]) == [(0, 0.2), (0.2, 1.0)]
    assert repaired(spark, [("a", -0.3, 0.2)]) == "TOKEN_OUT_OF_BOUNDS:0" and repaired(spark, [("a", 0, 0.2), ("b", 0.2, 1.3)]) == "TOKEN_OUT_OF_BOUNDS:1"
    assert repaired(spark, [("a", 0.5, 0.4)]) == "INVALID_INTERVAL:0" and repaired(spark, [("a", 0.5, 0.6), ("b", 0.3, 0.7)]) == "NON_MONOTONIC_TIME:1"
    assert repaired(spark, [("a", 1.0, 1.0)]) == "INVALID_INTERVAL:0" and repaired(spark, [("a", 0.2, 1.0), ("b", 1.0, 1.0)]) == "INVALID_INTERVAL:1"


def test_punctuation_and_recovery(spark):
    assert match.punctuated("«Hello», (world)!", ["hello", "world"]) == ["«hello»,", "(world)!"]
    assert match.punctuated("Yes.,, No (ma'am", ["yes", "no", "x", "ma'am"]) == ["yes.", "no", "x", "(ma'am"]
    assert match.punctuated("...", ["a"]) == ["a"] and match.significant("ﬁ-É’x!") == ("fié’x", [0, 0, 2, 3, 4])
    tokens = spark.createDataFrame([(1, i, 4 * i, 4 * i + 3, t) for i, t in enumerate("well then go on . Y. now".split())], "stream long, id long, s long, e long, text string")
    windows = spark.createDataFrame([(1, 1, 0, 14, "well then go on"), (1, 2, 0, 14, "well then go on"), (1, 3, 20, 22, "X!"), (1, 4, 8, 12, "nothing")], "stream long, win long, s long, e long, text string")
    anchors = spark.createDataFrame([(1, 4, "nothing")], "stream long, win long, anchor_text string")
    got = {r.win: (r.state, r.ids) for r in recovery.supported(windows, tokens, anchors, 10.0).collect()}
    assert got == {1: ("matched", [0, 1, 2, 3]), 2: ("rejected", []), 3: ("matched", [5]), 4: ("anchored", [])}
    assert recovery.likeness("abcdef", "ef") == 1.0 and recovery.likeness("abc", "x") is None and recovery.likeness("ab", "abc") is None


def test_stabilized_and_faults(spark):
    got = sorted(map(tuple, match.stabilized(frame(spark, [(1, 0, 0, 10), (1, 1, 6, 20)])).collect()))
    assert got == [(1, 0, 0.0, 8.0), (1, 1, 8.0, 20.0)]
    assert match.first_fault(frame(spark, [(1, 0, 5, 9), (1, 1, 4, 10)]), 0, 100).first().error == "NON_MONOTONIC_TIME:1"


def test_best_valley_equals_brute_force_at_every_frame(spark, sf):
    from tidemark.plans.record_queries import best_valley
    from tidemark.sources.frames import signal as frames

    track = signal.smooth_centered(frames(spark, sf), 5).withColumn("smooth", F.round("smooth", 6))
    found = {}
    for v in signal.valleys(track, 0.3, 2).selectExpr("stream", "center", "end - start AS width", "round(mean, 6) AS mean", "round(p95, 6) AS p95").collect():
        found.setdefault(v.stream, []).append(v)
    want = {}
    for f in frames(spark, sf).collect():
        a = f.frame
        cost = lambda v: round(0.65 * abs(v.center - (a + 45)) / 45 + 0.2 * v.mean + 0.1 * v.p95 - 0.05 * min(1.0, v.width), 9)  # noqa: E731, B023
        near = [(v.center > a + 60, cost(v), v.center) for v in found.get(f.stream, []) if a + 15 <= v.center <= a + 90]
        if near:
            want[f.stream, a] = min(near)[2]
    rows = best_valley(spark, sf).collect()
    assert {(r.stream, r.ask): r.center for r in rows} == want and len(rows) == len(want)
    assert any(a % 50 for _, a in want)


def test_runs_across_blocks(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(signal, "BLOCK", 8)
    for _ in range(4):
        flags = [rng.random() < rng.choice([0.2, 0.9]) for _ in range(20)] + [True] * rng.randrange(30) + [False] * rng.randrange(9)
        track = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(flags)], "stream string, frame long, smooth double")
        want, at = [], 0
        for v, group in itertools.groupby(flags):
            n = len(list(group))
            want.append((at, at + n, v))
            at += n
        assert sorted((r.start, r.end, r.flag) for r in signal.runs(track, F.col("smooth") >= 0.5).collect()) == want


def test_snap_is_exact_at_large_times(spark):
    ms = 1_704_067_200_123
    got = iv.snap(frame(spark, [(1, 0, ms, ms + 1), (1, 1, -7, -3)]), 30000, 1001).orderBy("id").collect()
    rate = Fraction(30000, 1001)
    assert [(r.start_frame, r.end_frame) for r in got] == [(floor(Fraction(ms, 1000) * rate), ceil(Fraction(ms + 1, 1000) * rate)), (floor(Fraction(-7, 1000) * rate), ceil(Fraction(-3, 1000) * rate))]


def test_speeds_and_scan(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 100, 200, 0, 0, 0, 0, 0, 0, 0, 0, 50])], "stream long, id long, amount long")
    got = [round(r.speed, 4) for r in records.speeds(rows).orderBy("id").collect()]
    assert got == [0, 100, 135, 67.5, 33.75, 16.875, 8.4375, 4.2188, 2.1094, 1.0547, 0, 50]


def test_block_analysis_slots(spark):
    track = spark.createDataFrame([("a", i, i / 100) for i in range(25)], "stream string, frame long, v double")
    values, regions = audio.analysed(track, 10, 4, lambda v: ([x + 1 for x in v[:9]], [(2, 40, 3.0)]), 1, 1)
    got = {r.frame: (round(r.value, 6), r.n_blocks) for r in values.collect()}
    assert got[0] == (1.0, 1) and got[7] == (1.07, 2) and got[24] == (1.24, 1) and len(got) == 25
    assert [(r.s, r.e, r.confidence) for r in regions.collect()] == [(2, 25, 1.0)]


def test_file_and_folder_forms(spark):
    from tidemark.operators import jobs

    assert jobs.document({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}'
    r = one(spark, jobs.response(F.lit('{"text":" a ","generated_tokens":"80"}'), 80))
    assert (r.text, r.generated, r.hit_limit, r.fault) == ("a", 80, True, None)
    with pytest.raises(ValueError):
        jobs.match_rows(None, "")


def test_isotonic_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.randrange(0, 4000) + 200 * i) for k in range(6) for i in range(rng.randrange(1, 40))]
    got = {(r.stream, r.i): r.fitted for r in signal.isotonic(spark.createDataFrame(rows, "stream long, i long, x long"), 100).collect()}
    for k in range(6):
        x = [v - 100 * i for s, i, v in sorted(rows) if s == k]
        mean = lambda a, b: sum(x[a : b + 1]) / (b - a + 1)  # noqa: B023, E731
        for i in range(len(x)):
            assert got[k, i] == pytest.approx(max(min(mean(j, m) for m in range(i, len(x))) for j in range(i + 1)) + 100 * i)


def test_window_expansion(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, 5.1), (1, 2, 5.1, 9.0), (2, 0, 0.0, 3.0), (2, 1, 3.0, 6.0), (3, 0, 0.0, 0.1), (3, 1, 0.1, 0.2), (3, 2, 0.2, 1.5)], "stream long, i long, s double, e double")
    durations = spark.createDataFrame([(1, 9.0), (2, 6.0), (3, 1.5)], "stream long, duration double")
    got = {}
    for r in signal.isotonic_expansion(rows, durations).orderBy("stream", "i").collect():
        got.setdefault(r.stream, []).append((round(r.s, 6), round(r.e, 6), r.moved))
    assert got[1] == [(0, 4.55, True), (4.55, 5.55, True), (5.55, 9.0, True)] and got[2] == [(0, 3, False), (3, 6, False)]
    assert got[3] == [(0, 0.5, True), (0.5, 1.0, True), (1.0, 1.5, True)]


def test_alignment_is_validated(spark):
    streams = spark.createDataFrame([(1, "ab cd", 0.0, 5.0), (2, "ab", 0.0, 5.0), (3, "ab cd ef", 0.0, 5.0), (4, " ", 0.0, 5.0), (5, "a b", 0.0, 5.0)], "stream long, transcript string, low double, high double")
    tokens = spark.createDataFrame([(1, 0, 0.0, 1.0, "Ab"), (1, 1, 1.0, 2.0, "cd."), (3, 0, 0.0, 1.0, "ab"), (3, 1, 1.0, 2.0, "xx"), (5, 0, 1.0, 2.0, "a"), (5, 1, 0.5, 3.0, "b")], "stream long, id long, s double, e double, text string")
    got = {r.stream: (round(r.coverage, 3), r.error) for r in match.validated(streams, tokens).collect()}
    assert got == {1: (1.0, ""), 2: (0.0, "EMPTY_ALIGNMENT"), 3: (0.4, "LOW_TEXT_COVERAGE"), 4: (1.0, ""), 5: (0.0, "NON_MONOTONIC_TIME:1")}


def test_joining_rules_agree(spark):
    """The rule on columns and the one that segmentation uses, and the groups of both."""
    from tidemark.functions import joining

    rng = random.Random(4)
    tokens = ["a", "ab", "B2", "3.", "5", "300", "30", "1,", "12,", "字", "かな", "한", "ｱ", "é", "(", ")", "«", "»", "。", "…", "-", "$", "a-b", "x,", "２．", "½"]
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(400)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a string, b string")
    rows = df.select("id", *(joining.joiner(F.col("a"), F.col("b"), F.lit(lang)).alias(lang) for lang in ("en", "ja"))).collect()
    for r in rows:
        assert (r.en, r.ja) == (boundaries.between(*pairs[r.id], False), boundaries.between(*pairs[r.id], True)), pairs[r.id]
    texts = ["It's 3.5-fold, Straße ﬁ", "漢字かなab12 한국어", "a.-b 'x' ０１", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for lang in ("en", "zh"):
        got = df.select(joining.mapping_groups(tx.folded(F.col("t")), F.lit(lang)).alias("g")).collect()
        assert [r.g for r in got] == [tx.mapping_groups_value(t, lang) for t in texts]
    assert one(spark, joining.joined(F.array(*map(F.lit, (" a", "", "(", "b", ")", "."))), F.lit("en"))) == "a (b)."


def test_model_slots(spark):
    from tidemark.operators import models

    track = spark.createDataFrame([("a", i, i / 10) for i in range(10)], "stream string, frame long, v double")
    windows = spark.createDataFrame([("a", 1, 0, 3, "p", 500), ("a", 2, 8, 20, "", 500), ("a", 3, 30, 40, "", 500)], "stream string, win long, start long, end long, prompt string, speech_ms long")
    held = models.window_samples(track, windows)
    assert {r.win: r.samples for r in held.collect()} == {1: [0.0, 0.1, 0.2], 2: [0.8, 0.9], 3: None}

    def load():
        return lambda v, language, prompt: {"text": f"{len(v)} {prompt}" if v else "", "generated_tokens": 200 if len(v) == 2 else 3}

    got = {r.win: (r.text, r.error, r.valid) for r in models.transcribed(held, load).collect()}
    assert got == {1: ("3 p", "", True), 2: ("", "ASR_TOKEN_LIMIT_REACHED", False), 3: ("", "EMPTY_TRANSCRIPT_FOR_SPEECH", False)}
    texts = held.where("win < 3").select("stream", "win", F.lit(5.0).alias("offset"), "samples", F.lit("x y").alias("text"), F.lit("en").alias("language"))
    found = models.aligned(texts, lambda: lambda v, text, language: [(w, i, i + 0.5) for i, w in enumerate(text.split())]).collect()
    assert sorted((r.win, r.ord, r.text, r.start, r.end) for r in found) == [(w, i, t, 5.0 + i, 5.5 + i) for w in (1, 2) for i, t in enumerate("xy")]
