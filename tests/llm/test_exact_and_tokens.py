import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from oracle import spark_rows, sql_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, exact_dedup, packing, quality_rules, queries, token_counts
from tidemark.llm.common import materialise
from tidemark.llm.word_tokens import word_tokens

ODD = ["", " ", "\n\n", "don't we've", "a  b", "ÀÉ ß İstanbul ΣΑΣ", "漢字 かな 😀👍🏽", "\0\x1c\x85 x", "<|endoftext|> a", "x" * 3000, "ha" * 2000, " " * 500, "1,234.5 a.,b ... 's 'S", "é ́a"]


def texts(n=300, seed=1):
    rng = random.Random(seed)
    alphabet = "abcdeé ñ\n\t  'st're漢字😀 12 3!?#\0\x1c  the ing İ,."
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(n)]


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def clashing(spark, df):
    """The same table with columns named like operators' own."""
    for name in ("norm", "h128", "keep_id", "kept", "rank", "whole", "sha", "names", "bands", "key", "a", "b", "root", "id", "n_words", "__parts", "score"):
        df = df.withColumn(name, F.lit("x"))
    return df


# exact dedup


def test_exact_classes_and_edges(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, "ÄB"), (4, "äb"), (5, None), (6, ""), (6, ""), (None, "ab"), (7, "x" * 200_000)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(clashing(spark, docs(spark, rows)), keep="max").collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 1, True)}
    assert exact_dedup.classes(docs(spark, [])).count() == 0


def test_exact_deduplicate_keeps_whole_rows(spark):
    df = clashing(spark, docs(spark, [(2, "A"), (1, "a"), (1, "a"), (None, "a"), (3, None)])).withColumn("hot", F.lit("x"))
    got = exact_dedup.deduplicate(df)
    assert {v for r in got.collect() for c, v in r.asDict().items() if c not in ("doc_id", "text")} == {"x"}
    assert got.columns == df.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a"), (3, None)]
    assert [r.doc_id for r in exact_dedup.deduplicate(df.where("text IS NOT NULL"), keep="max").collect()] == [2]


@pytest.mark.parametrize("broadcast", [1 << 24, 0])
def test_exact_collision_is_no_group(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.when(F.length(c) < 3, "same").otherwise(F.sha2(c, 256)))
    monkeypatch.setattr(exact_dedup, "BROADCAST", broadcast)
    rows = [(1, "a"), (2, "b"), (3, "A"), (4, "long"), (5, "LONG"), (6, "alone")]
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.classes(docs(spark, rows)).collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 2), 5: (4, 2), 6: (6, 1)}
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs(spark, rows)).collect()) == [1, 2, 4, 6]


# byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.text_encoder("byte_bpe_50k.tiktoken").bpe.ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_and_round_trips(spark, reference):
    t = texts()
    rows = [(i, x) for i, x in enumerate(t)] + [(9000, None)]
    got = {r.doc_id: r for r in byte_bpe.digests(clashing(spark, docs(spark, rows))).collect()}
    for i, x in rows:
        ids = reference.encode_ordinary(x or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, repr(x)
    assert byte_bpe.digests(docs(spark, [])).count() == 0


def test_bpe_general_form(spark, reference):
    ids = byte_bpe.encoded(docs(spark, [(1, "Hello wörld"), (2, None)]))
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: reference.encode_ordinary("Hello wörld"), 2: []}
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decoded(ids).collect()} == {1: "Hello wörld".encode(), 2: b""}


def test_bpe_pieces_of_random_bytes(reference):
    bpe, rng = byte_bpe.text_encoder("byte_bpe_50k.tiktoken").bpe, random.Random(2)
    for _ in range(2000):
        piece = "".join(rng.choice("aehinst") for _ in range(rng.randrange(1, 40))).encode()
        assert bpe.encode_piece(piece) == reference.encode_ordinary(piece.decode()) == bpe._merged(piece)
    for _ in range(2000):
        piece = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30)))
        assert bpe.encode_piece(piece) == bpe._merged(piece) and bpe.decode(bpe.encode_piece(piece)) == piece


def test_bpe_caches_change_nothing(reference):
    encoder = byte_bpe.TextEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder.chunks.bound = encoder.pieces.bound = 50
    encoder.bpe.memo = 20
    t = texts(1500, 11) + ["ab" * 40_000, "\n" * 3000 + "x", "a\n b\nc  d\n\ne", "a\0 b\nc", "a\x1cb c\x85d"]
    for i in range(0, len(t), 40):
        assert [list(map(int, j.split())) for j in encoder.ids(t[i : i + 40])] == [reference.encode_ordinary(x) for x in t[i : i + 40]]


# packing


def test_packing_is_whole_and_tight(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(docs(spark, [(10**6 + i, t) for i, t in enumerate([None, "a <|endoftext|> b", *texts(60)])]))
    rows = packing.packed(df).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], np.uint32) for r in df.collect()}
    seen, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
    assert set(seen) == set(ids)
    for doc, pieces in seen.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[doc])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_packing_closes_windows_of_every_tier():
    rng = random.Random(4)
    packer, lengths = packing.Packer(hold=64), [int(4096 ** rng.random()) for _ in range(3000)] + [9000]
    for doc, n in enumerate(lengths):
        packer.add(doc, np.arange(n, dtype=np.uint32))
    packer.finish()
    sequences, seen = {}, Counter()
    for doc, start, ids, total, number, offset, tier, _ in packer.out:
        assert ids.tolist() == list(range(start, start + len(ids))) and total == lengths[doc]
        sequences.setdefault((number, tier), []).append((offset, len(ids)))
        seen[doc] += len(ids)
    assert seen == dict(enumerate(lengths))
    closed = Counter(tier for _, tier in sequences)
    assert all(closed[t] > 20 for t in packing.TIERS) and all(closed[t] <= 1 for t in closed if t < 512), closed
    for (_, tier), pieces in sequences.items():
        assert sum(n for _, n in pieces) == tier
        assert tier < 1024 or min(pieces)[1] > tier // 2 or min(pieces)[1] == tier


def test_packing_step_groups_are_of_one_tier_and_balanced(spark):
    rng = random.Random(6)
    df = docs(spark, [(i, "the cat sat on " * int(18 ** rng.random())) for i in range(1500)]).repartition(3)
    rows = packing.packed(df, tiers=(8, 16, 32, 64), group_tokens=256).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.step_group, set()).add((r.tier, r.sequence_id))
    sizes = {}
    for members in groups.values():
        (tier,) = {t for t, _ in members}
        assert len(members) * tier <= 256
        sizes.setdefault(tier, []).append(len(members))
    assert {8, 16, 32, 64} <= set(sizes)
    for tier, n in sizes.items():
        assert max(n) - min(n) <= 1 and len(n) == -(-sum(n) // (256 // tier))


def test_packing_edges(spark):
    got = packing.packed(clashing(spark, docs(spark, [(1, None), (1, ""), (None, "a")])), with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got) == [(0, 2), (1, 1), (1, 1)] and packing.packed(docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_ids_equal_library(name):
    """The plain library, as its file loads: it makes added tokens of their strings in a text."""
    plain, tokens, rng = Tokenizer.from_file(public_tokenizers.path(name)), word_tokens(name), random.Random(3)
    kinds = ["ab cdé\n", "the in ger.\n $$$ 's don't", "Привет и ", "\x00\x85\xa0 日本😀 a", "01234 ,.!?-_ ", "ªºµßÿÀÉ a.'s", "Σσς ΑΒ İI ", "<|endoftext|> ab", "e\u0301 \u200b\ufeff "]
    t = texts(2000, 5) + ["Hello <|endoftext|> there", "<|startoftext|>x", "<|ENDOFTEXT|>", "w'$$$ it's're x'tea", "a" * 9000]
    t += ["".join(rng.choice("".join(rng.sample(kinds, 2))) for _ in range(rng.randrange(50))) for _ in range(3000)]
    for i in range(0, len(t), 500):
        assert all(a.tolist() == plain.encode(x, add_special_tokens=False).ids for a, x in zip(tokens.ids(t[i : i + 500]), t[i : i + 500]))


# quality rules


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            again |= {i, i + 1, i + 2}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again))


def test_quality_base_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**6 + i, t) for i, t in enumerate([None, *texts(200, 3), "a b c\na b c\n\n", "l\nl\nl"])]
    got = {r.doc_id: r for r in quality_rules.judged(clashing(spark, docs(spark, rows)), quality_rules.PRIOR).collect()}
    for i, t in rows:
        r, want = got[i], base(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_learns_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_rules.judged(d, quality_rules.fit(d, labels, sample_rows=60)).join(labels, "doc_id").where("NOT base_failed")
    right = judged.select(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97
    assert quality_rules.fit(d, labels.limit(0)) is quality_rules.PRIOR


def test_quality_finds_boilerplate_inside_prose(spark):
    """Lines in a document of both kinds, known here, which no label tells apart; the verdict is recomputed from them."""
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_rules.fit(d, labels, sample_rows=200)
    good = [r.text for r in d.join(labels, "doc_id").where("quality = 1 AND n_chars BETWEEN 600 AND 3000").orderBy("doc_id").collect()]
    junk = ["Home | News | Sport | Terms | Privacy | Login | Search", "win*** cash$$$ now&&& free%%% best### buy$$$"] * 3
    rows, truth = [], {}
    for i, text in enumerate(good[:60]):
        prose = [x for x in text.split("\n") if len(x.split()) > 5]
        at = i % (len(prose) + 1)
        rows.append((i, "\n".join([*prose[:at], "", *junk[: i % 5 + 2], *prose[at:]])))
        truth[i] = [1] * at + [None] + [0] * (i % 5 + 2) + [1] * (len(prose) - at)
    flags = {r.doc_id: r for r in quality_rules.lines(docs(spark, rows), model).collect()}
    pairs = [(f, t) for i, want in truth.items() for f, t in zip(flags[i].is_content, want, strict=True)]
    assert all((f is None) == (t is None) for f, t in pairs)
    assert np.mean([f for f, t in pairs if t == 1]) > 0.95 and np.mean([not f for f, t in pairs if t == 0]) > 0.95
    for r in quality_rules.judged(docs(spark, rows), model).collect():
        text = rows[r.doc_id][1].split("\n")
        words = [len(x.split()) for x in text]
        share = sum(w for w, f in zip(words, flags[r.doc_id].is_content) if f) / sum(words)
        assert 0 < share < 1 and r.content_share == pytest.approx(share) and r.kept == (not r.base_failed and share >= 0.5)
        assert flags[r.doc_id].content == "\n".join(x for x, f in zip(text, flags[r.doc_id].is_content) if f)


def test_quality_fit_is_bounded(spark):
    rows = [(1, "good words of a text")] * 50 + [(2, "bad&&& %%% text***"), (3, "x " * 400_000)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    seen = []
    real = quality_rules.learnt
    quality_rules.learnt = lambda bags: seen.append(len(bags)) or real(bags)
    try:
        quality_rules.fit(docs(spark, rows), labels)
    finally:
        quality_rules.learnt = real
    assert seen == [2]


def test_viterbi_is_the_best_sequence():
    from itertools import product

    from tidemark.llm import crf_lines

    rng = np.random.default_rng(1)
    model = {"w": rng.normal(size=(3, 2)), "a": rng.normal(size=(2, 2)), "s": rng.normal(size=2)}
    for n in range(1, 7):
        x = rng.normal(size=(n, 3))
        score = lambda y: model["s"][y[0]] + sum((x @ model["w"])[i, k] for i, k in enumerate(y)) + sum(model["a"][p, q] for p, q in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(crf_lines.viterbi(model, [x])[0]) == max(product((0, 1), repeat=n), key=score)


# token counts


def test_rollup_is_idempotent_and_signed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "s", "en"), (2, None, None, "en"), (3, "c", "s", None), (3, "c", "s", None)], "doc_id long, text string, source string, lang string")
    counts = materialise(token_counts.counted(clashing(spark, df)), "t")
    store = token_counts.RollupStore(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    assert store.commit("one", token_counts.signed(counts, 1)) and not store.commit("one", token_counts.signed(counts, 1))
    after = counts.where("doc_id = 1").withColumn("n_tokens", F.lit(7).cast("long"))
    assert store.commit("two", token_counts.revised(counts.where("doc_id = 1"), after))
    assert store.commit("three", token_counts.signed(counts.where("doc_id = 3"), -1))
    want = {("s", "en", 1, 7), (None, "en", 1, 0)}
    rows = lambda: {(r.source, r.lang, r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert rows() == want
    store.compact()
    assert rows() == want and store.committed() == ["one", "three", "two"] and not store.commit("two", token_counts.signed(counts, 1))


def _store(spark, tmp_path):
    one = spark.createDataFrame([("s", "en", "v", 1, 10, 100)], token_counts.SCHEMA)
    store = token_counts.RollupStore(spark, f"file://{tmp_path}/store")
    return store, one, lambda: tuple(store.totals().select("n_docs", "n_tokens").first() or ())


class Died(Exception):
    pass


def _dies(*_):
    raise Died


def test_rollup_survives_a_crash_at_each_step(spark, tmp_path, monkeypatch):
    store, one, total = _store(spark, tmp_path)
    for step in range(3):
        for name in ("_write", "_publish"):
            with monkeypatch.context() as m:
                m.setattr(token_counts.RollupStore, name, _dies)
                with pytest.raises(Died):
                    store.commit(f"b{step}", one)
            assert total() == ((step, 10 * step) if step else ())
        store.commit(f"b{step}", one)
        assert total() == (step + 1, 10 * step + 10)
        for name in ("_write", "_publish"):
            with monkeypatch.context() as m:
                m.setattr(token_counts.RollupStore, name, _dies)
                if step:
                    with pytest.raises(Died):
                        store.compact()
            assert total() == (step + 1, 10 * step + 10)
        store.compact()
        assert total() == (step + 1, 10 * step + 10) and not store.commit("b0", one)
    store.vacuum(older_than=-10)
    assert total() == (3, 30) and len(store._names("data")) == 1 and store.committed() == ["b0", "b1", "b2"]


def test_rollup_of_writers_at_once(spark, tmp_path, monkeypatch):
    store, one, total = _store(spark, tmp_path)
    with ThreadPoolExecutor(6) as pool:
        applied = list(pool.map(lambda i: store.commit(["a", "b" * 300, "a/=+é"][i % 3], one), range(9)))
    assert sum(applied) == 3 and total() == (3, 30)
    real, late = token_counts.RollupStore._write, []

    def beside(self, deltas):  # a batch comes in while a compaction sums
        folder = real(self, deltas)
        if not late:
            late.append(1)
            store.commit("late", one)
        return folder

    monkeypatch.setattr(token_counts.RollupStore, "_write", beside)
    store.compact()
    assert total() == (4, 40) and len(store.committed()) == 4


def test_rollup_of_many_ids(spark, tmp_path):
    store, one, total = _store(spark, tmp_path)
    folder = store._write(one)
    assert store._publish(1, {"folder": folder, "batches": [f"id {i}" * 10 for i in range(10_000)]}) and not store._publish(1, {})
    store.commit("more", one)
    store.compact()
    assert total() == (2, 20) and len(store.committed()) == 10_001 and not store.commit("id 77" * 10, one)


def test_rollup_query_equals_brute_force(spark, sf):
    def encoding(name):
        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    names = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
    known, want, seen = {n: encoding(n) for n in names}, {}, set()
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        text = r.text or ""
        same = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        if same not in seen:
            seen.add(same)
            name = names[r.lang != "en"]
            total = want.setdefault((r.source, r.lang, name), [0, 0, 0])
            for i, n in enumerate((1, len(known[name].encode_ordinary(text)), len(text))):
                total[i] += n
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens, r.n_chars] for r in queries.op7_token_counts(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(queries.ORACLE[name], sf)


def test_pattern_is_the_library_s():
    assert regex.findall(public_tokenizers.PATTERN, "a  b") == ["a", " ", " b"]
