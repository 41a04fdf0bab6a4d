import base64
import collections
import gzip
import hashlib
import itertools
import json
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_exact_and_tokens import clashing, docs

import corpus_pipeline
from tidemark.llm import gru, order_minhash, pii_surrogates, queries, recompression, substring_dedup, toxicity, warc
from tidemark.llm.wordhash import rolled, word_hashes

# WARC


def test_warc_round_trip(spark, tmp_path):
    page = "<html lang='de'><head><title>A &amp; B</title><script>x</script></head><body><p>Eins<br>zwei</p><a href='/u?a=1&amp;b=2'>l</a></body>"
    rows = [(1, "http://e.example/", page), (1, "http://e.example/", page), (2, None, None), (None, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit("x"))
    got = warc.derivatives(df).collect()
    assert len(got) == 8 and warc.derivatives(df.limit(0)).count() == 0
    text = [bytes(r.block).decode() for r in got if r.page_id == 1 and r.record_type == "conversion"][0]
    assert text == "A & B\nEins\nzwei\nl"
    meta = [bytes(r.block).decode() for r in got if r.page_id == 1 and r.record_type == "metadata"][0]
    assert "title: A & B\r\n" in meta and "language: de\r\n" in meta and "outlink: /u?a=1&b=2\r\n" in meta
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nServer: s\r\n\r\n" + page.encode()
    source = warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://e.example/"), ("WARC-Date", "2020-01-01T00:00:00Z")], http)
    (tmp_path / "a.warc").write_bytes(warc.record_bytes([("WARC-Type", "warcinfo")], b"") + source)
    derived = warc.derive_responses(warc.read_responses(spark, str(tmp_path / "a.warc"))).collect()
    assert {r.refers_to for r in derived} == {"<urn:uuid:1>"} and {r.source_payload_digest for r in derived} == {warc.digest(page.encode())}
    assert bytes([r for r in derived if r.record_type == "conversion"][0].block).decode() == text
    out = warc.derive("<urn:uuid:1>", "u", "d", [("Server", "s")], page, page.encode())
    heads = [dict(h) for h, b in warc.parse_records(b"".join(r["record"] for r in out)) if warc.digest(b) == dict(h)["WARC-Block-Digest"]]
    assert [h["WARC-Type"] for h in heads] == ["metadata", "conversion"] and all(h["WARC-Refers-To"] == "<urn:uuid:1>" for h in heads)


def test_warc_bodies_headers_and_sink(spark, tmp_path):
    page = "<html><body><p>Grüße</p></body></html>"
    packed = gzip.compress(page.encode())
    chunked = b"5\r\n" + packed[:5] + b"\r\n" + f"{len(packed) - 5:x}".encode() + b"\r\n" + packed[5:] + b"\r\n0\r\n\r\n"
    sent = {
        "a": (b"Content-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2", chunked),
        "b": (b"Content-Type: image/png", b"\x89PNG\r\n\x1a\n"),
        "c": (b"Content-Type: text/html; charset=iso-8859-1", page.encode("latin-1")),
        "d": (b"Content-Encoding: br", b"x"),
        "e": (b"Content-Type: text/html", b"<meta charset=iso-8859-1>" + page.encode("latin-1")),
        "f": (b"Content-Type: text/html\r\nTransfer-Encoding: chunked", page.encode()),
    }
    record = lambda name, head, body: warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", name)], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)
    for k in range(2):
        parts = [gzip.compress(record(n, h, b)) for n, (h, b) in list(sent.items())[k::2]]
        (tmp_path / f"in {k}.warc.gz").write_bytes(b"".join(parts))
    derived = warc.derive_responses(warc.read_responses(spark, str(tmp_path), batch_bytes=10)).cache()
    rows = {(r.refers_to, r.record_type): r for r in derived.collect()}
    assert {n for n, kind in rows if kind == "conversion"} == {"a", "c", "e", "f"} and len(rows) == 10
    assert all(bytes(rows[n, "conversion"].block).decode() == "Grüße" for n in "acef")
    assert bytes(rows["a", "metadata"].block).decode().count("http-header: Set-Cookie") == 2 and json.loads(rows["a", "metadata"].source_headers)[-1] == ["Set-Cookie", "b=2"]
    assert rows["a", "metadata"].source_payload_digest == warc.digest(chunked)
    twice = derived.unionByName(derived)
    assert warc.distinct_records(twice).count() == 10
    files = warc.write_records(derived.coalesce(2), f"{tmp_path}/out").collect()
    assert sum(r.n_records for r in files) == 10
    read = [(dict(h), b) for r in files for h, b in warc.parse_records(open(f"{tmp_path}/out/{r.file}", "rb"))]
    assert {(h["WARC-Refers-To"], h["WARC-Type"], h["WARC-Block-Digest"]) for h, _ in read} == {(*k, r.block_digest) for k, r in rows.items()}
    assert all(warc.digest(b) == h["WARC-Block-Digest"] for h, b in read)


def test_warc_query_equals_a_plain_parser(spark, sf):
    """Text and links found by the standard library's parser, and digests, for every page."""
    hidden, breaks = {"script", "style", "noscript", "template", "svg"}, set("p div br hr li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav main aside blockquote pre title head body html form dd dt dl".split())

    class Page(HTMLParser):
        def __init__(self):
            super().__init__()
            self.text, self.links, self.inside = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.inside += tag in hidden
            self.text += ["\n"] * (tag in breaks)
            self.links += [v for k, v in attrs if tag == "a" and k == "href" and not self.inside]

        def handle_endtag(self, tag):
            self.inside -= tag in hidden
            self.text += ["\n"] * (tag in breaks)

        def handle_data(self, data):
            if not self.inside:
                self.text.append(data)

    got = {(r.page_id, r.record_type): r for r in queries.op2_warc_derivatives(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == 2 * len(pages)
    for r in pages:
        page = Page()
        page.feed(r.html or "")
        page.close()
        lines = [" ".join(x.split()) for x in "".join(page.text).split("\n")]
        text, meta = bytes(got[r.page_id, "conversion"].block), bytes(got[r.page_id, "metadata"].block).decode()
        assert text.decode() == "\n".join(x for x in lines if x)
        assert regex.findall(r"(?m)^outlink: (.*)\r$", meta) == list(dict.fromkeys(x for x in page.links if x))
        for kind in ("conversion", "metadata"):
            d = got[r.page_id, kind]
            assert d.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(d.block)).digest()).decode() and d.content_length == len(d.block) and d.refers_to == got[r.page_id, "metadata"].refers_to


# toxicity


def test_gradients():
    gru.F32, kept = np.float64, gru.F32
    try:
        p = {k: v.astype(float) for k, v in gru.fresh(4).items()}
        rng = np.random.default_rng(0)
        ids, chars = np.array([0, 1, 2, 3]), gru.characters(["", "ab", "cde", "f"])
        idx, mask, y = rng.integers(0, 4, (3, 5)), np.ones((3, 5)), np.array([0, 1, 1.0])
        mask[1, 3:] = 0

        def loss(full=False):
            x = gru.inputs(p, ids, chars)
            gx = {d: x @ p["W" + d] + p["c" + d] for d in "fb"}
            logit, saved = gru.forward(p, gx, idx, mask, keep=True)
            value = (np.logaddexp(0, logit) - y * logit).sum()
            return (value, logit, saved, gx) if full else value

        _, logit, saved, gx = loss(True)
        g, _ = gru.backward(p, gx, idx, mask, saved, 1 / (1 + np.exp(-logit)) - y)
        for k in g:
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            old = p[k][at]
            p[k][at] = old + 1e-5
            up = loss()
            p[k][at] = old - 1e-5
            down = loss()
            p[k][at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[k][at], rel=1e-3, abs=1e-7)
    finally:
        gru.F32 = kept


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        doc, first, count = gru.windows(np.array([3, n]), 32, 16)
        mine = [(f - 3, c) for d, f, c in zip(doc, first, count) if d == 1]
        assert sorted({i for f, c in mine for i in range(f, f + c)}) == list(range(n)) and all(f + c <= n for f, c in mine)


def test_character_lists():
    tri, begin = gru.characters(["", "a", "ab", "abc", "x" * 30])
    assert tri.sizes.tolist() == [1, 1, 2, 3, 30] and begin.sizes.tolist() == [1, 1, 1, 2, 8]
    alone = gru.characters(["abc"])
    assert tri.take(np.array([3])).flat.tolist() == alone[0].flat.tolist() and begin.take(np.array([3])).flat.tolist() == alone[1].flat.tolist()


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scorer = toxicity.fit(d, labels)
    rows = toxicity.scores(clashing(spark, d), scorer).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good[0] for b in good[1]])
    assert auc > 0.8 and np.mean([s >= 0.7 for s in good[1]]) < 0.05
    odd = docs(spark, [(1, None), (2, ""), (2, " "), (None, "idiot " * 50_000)])
    got = toxicity.scores(odd, scorer).collect()
    assert len(got) == 4 and len({r.score for r in got[:3]}) == 1 and got[3].held_out is False
    assert toxicity.keep_harmless(odd, scorer).columns == odd.columns
    assert toxicity.fit(d, labels.limit(0)) is None and {r.score for r in toxicity.scores(odd, None).collect()} == {0.0}


def plain_score(scorer, text):
    """One word after the other, without batches, caches or padding."""
    p, k = {n: v.astype(float) for n, v in scorer.p.items()}, len(scorer.p["v"])
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        c = toxicity.core(word)
        lists = gru.characters([c])
        return np.concatenate([p["Ew"][scorer.vocabulary.get(c, 0)], *(p[n][x.flat].mean(0) for n, x in zip(("Ec", "Eb"), lists))])

    def run(vectors, d):
        h, out = np.zeros(k), []
        for x in vectors:
            g, a = x @ p["W" + d] + p["c" + d], h @ p["U" + d]
            z, r = sigmoid(g[:k] + a[:k]), sigmoid(g[k : 2 * k] + a[k : 2 * k])
            h = z * h + (1 - z) * np.tanh(g[2 * k :] + r * a[2 * k :])
            out.append(h)
        return out

    words = text.lower().split()
    logits = []
    for at in range(0, max(1, len(words) - toxicity.SIZE + toxicity.STRIDE), toxicity.STRIDE) if words else ():
        x = [vector(w) for w in words[at : at + toxicity.SIZE]]
        states = [np.concatenate(pair) for pair in zip(run(x, "f"), run(x[::-1], "b")[::-1])]
        weight = np.exp([np.tanh(s @ p["A"]) @ p["v"] for s in states])
        logits.append(sum(w * s for w, s in zip(weight / weight.sum(), states)) @ p["o"] + p["b"][0])
    weights, low = scorer.scale
    top = min(12, max(-12, max(logits))) if logits else low
    mean = np.mean(sigmoid(np.clip(logits, -30, 30))) if logits else sigmoid(low)
    held, n = min(1 - 1e-5, max(1e-5, mean)), np.log(max(1, len(logits)))
    return sigmoid(np.array([top, np.log(held / (1 - held)), mean, n, mean * n]) @ weights[:-1] + weights[-1])


def test_toxicity_equals_the_plain_network(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = d.join(labels, "doc_id").where("toxic IS NOT NULL").select("text", "toxic").limit(60).collect()
    scorer = toxicity.train([r.text or "" for r in rows], np.array([r.toxic for r in rows]))
    rng = random.Random(1)
    odd = ["", " ", "a", "«!»", " ".join(["w"] * 32), " ".join(["w"] * 33), " ".join(rng.choice(["x", "idiot!", "ünï", "漢字", "."]) for _ in range(200))]
    texts = odd + [r.text or "" for r in d.limit(20).collect()]
    assert np.allclose(scorer.scores(texts), [plain_score(scorer, t) for t in texts], atol=2e-4)
    assert np.allclose(scorer.scores(texts), np.concatenate([scorer.scores([t]) for t in texts]), atol=1e-5)


def test_toxicity_precision_and_recall(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.scores(d.join(labels.where("toxic IS NOT NULL"), "doc_id", "left_semi"), toxicity.fit(d, labels)).join(labels, "doc_id").where("held_out").collect()
    hit, said, true = (sum(f(r) for r in held) for f in (lambda r: r.predicted and r.toxic == 1, lambda r: r.predicted, lambda r: r.toxic == 1))
    assert len(held) > 1000 and hit / said > 0.85 and hit / true > 0.85, (hit, said, true)


# substring dedup


def cut(rows, size=50):
    first, out = {}, []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    for d, t in rows:
        w = (t or "").encode().split()
        stay = [True] * len(w)
        for i in range(len(w) - size + 1 if d is not None else 0):
            if first[tuple(w[i : i + size])] < d:
                stay[i : i + size] = [False] * size
        out.append((d, len(w), stay.count(False), hashlib.sha256(b" ".join(x for x, s in zip(w, stay) if s)).hexdigest()))
    return sorted(out, key=str)


def repeats(seed):
    rng = random.Random(seed)
    passages = [[rng.choice("ab") for _ in range(300)], ["x"] * 300, ["p", "q", "r"] * 100, [f"w{rng.randrange(500)}" for _ in range(300)]]
    rows = []
    for d in rng.sample(range(10**6), 90):
        w = []
        for _ in range(rng.randrange(5)):
            p, a = rng.choice(passages), rng.randrange(200)
            w += p[a : a + rng.randrange(20, 140)] + [rng.choice("abcdefgh") for _ in range(rng.randrange(15))]
        rows.append((d, " ".join(w)))
    return rows


def test_substring_equals_brute_force(spark):
    rows = repeats(5) + [(5, None), (6, ""), (7, " \n "), (None, " ".join(["x"] * 80)), (10**7, "y " * 30_000), (10**7 + 1, "y " * 30_000)]
    rows += [rows[0], (10**7 + 2, rows[1][1])]
    got = sorted(map(tuple, substring_dedup.removed(clashing(spark, docs(spark, rows))).collect()), key=str)
    assert got == cut(rows)
    assert substring_dedup.removed(docs(spark, [])).count() == 0


def test_words_of_like_structure_are_told_apart(spark):
    """Thue-Morse words agree under polynomials modulo powers of two."""
    thue = ["ab"[i.bit_count() % 2] for i in range(2048)]
    one, two = "".join(thue), "".join("ba"["ab".index(c)] for c in thue)
    rest = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest])), (3, " ".join([one, *rest]))]
    assert word_hashes(one.encode()) != word_hashes(two.encode())
    assert sorted(map(tuple, substring_dedup.removed(docs(spark, rows)).collect())) == cut(rows)
    rows = [(1, " ".join(thue)), (2, " ".join("ba"["ab".index(c)] for c in thue))]
    assert {r.class_rep for r in order_minhash.classes(docs(spark, rows)).collect()} == {1, 2}
    assert sorted(map(tuple, substring_dedup.removed(docs(spark, rows)).collect())) == cut(rows)


def test_substring_text_and_real_rows(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = substring_dedup.removed(docs(spark, rows), with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == cut(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got if r.n_removed)


def test_seeds_depend_on_the_window_alone():
    rng = random.Random(3)
    shared = [rng.choice(["a", "b", f"v{rng.randrange(99)}"]) for _ in range(90)]
    by_window = {}
    for k in range(40):
        words = [f"{k}-{rng.randrange(9)}" for _ in range(rng.randrange(40))] + shared + [f"{k}" for _ in range(rng.randrange(40))]
        h = word_hashes(" ".join(words).encode())
        first, name, _ = recompression.blocks(h)
        names = np.repeat(name, np.diff(np.append(first, len(h) - 49)))
        for w, n in zip(rolled(h, 50).tolist(), names.tolist()):
            assert by_window.setdefault(w, n) == n


def test_word_hashes_split_as_bytes_do():
    for text in ("", " a\x0bb\x1cc d ", "é  ß\n\n", "x"):
        data = text.encode()
        h = word_hashes(data)
        assert len(h) == len(data.split()) and h.tolist() == [int(word_hashes(w)[0]) for w in data.split()]


# near duplicates


def near_classes(rows):
    seq, parent = {}, {}
    for d, t in rows:
        s = order_minhash.shingles(t or "")
        parent[d] = d
        if len(s):
            seq.setdefault(s.tobytes(), []).append(d)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    reps = {min(v): (np.frombuffer(k, np.uint64), v) for k, v in seq.items()}
    for r, (_, v) in reps.items():
        for d in v:
            join(r, d)
    for a, b in itertools.combinations(sorted(reps), 2):
        x, y = reps[a][0], reps[b][0]
        if (collections.Counter(x.tolist()) & collections.Counter(y.tolist())).total() >= 0.5 * max(len(x), len(y)):
            m = order_minhash.matches(x, y, len(x) + len(y))
            if m / (len(x) + len(y) - m) >= 0.8:
                join(a, b)
    return {d: root(d) for d in parent}


def altered(seed, n, base_words=150):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(base_words)]
    rows = []
    for d in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(base_words)] = f"w{rng.randrange(3000)}"
        rows.append((d + 100, " ".join(w)))
    return rows


def test_near_equals_brute_force(spark):
    rng = random.Random(2)
    passage = [f"w{rng.randrange(3000)}" for _ in range(60)]
    rows = altered(2, 80) + [(1000 + d, " ".join(passage + [f"w{rng.randrange(3000)}" for _ in range(60)])) for d in range(40)]
    rows += [(1, None), (2, ""), (3, "a b"), (4, "a b"), (4, "a b"), (5, "A  b"), (9000, "long " * 20_000), (9001, "long " * 20_001)]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(clashing(spark, docs(spark, [*rows, (None, "a b")]))).collect()}
    assert got == near_classes(rows)
    assert order_minhash.classes(docs(spark, [])).count() == 0


def test_rare_shingles_find_every_similar_pair(spark):
    rng = random.Random(12)
    rows = []
    for k in range(6):  # chains of altered copies, and texts that share half of a template
        w = [f"w{rng.randrange(400)}" for _ in range(60 + 20 * k)]
        for _ in range(12):
            w = list(w)
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            rows.append((len(rows), " ".join(w)))
    template = [f"t{i}" for i in range(50)]
    rows += [(1000 + i, " ".join(template + [f"x{rng.randrange(10**6)}" for _ in range(40)])) for i in range(300)]
    members = spark.createDataFrame([(i, i) for i, _ in rows], "doc_id long, root long")
    got = {(r.a, r.b) for r in order_minhash._prefixed(docs(spark, rows), members, 0.8).collect()}
    sets = {i: order_minhash.shingles(t) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if order_minhash.similarity(sets[a], sets[b], 0.8) >= 0.8}
    assert len(want) > 30 and want <= got and not any(a >= 1000 for a, _ in got)
    one = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, root long")
    assert order_minhash._prefixed(docs(spark, rows), one, 0.8).count() == 0


def test_near_recall_on_real_rows(spark, sf):
    """Classes on whole documents against alignment of every pair that shares enough shingles."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs(spark, rows)).collect()}
    assert got == near_classes(rows)


def test_a_worker_holds_one_thing(monkeypatch):
    import weakref

    from tidemark.llm import common
    from tidemark.llm.word_tokens import word_tokens

    seen = weakref.ref(word_tokens("word_bpe_49k.json"))
    assert word_tokens("word_bpe_49k.json") is seen()
    common.held("other", dict)
    assert seen() is None and list(common._HELD) == ["other"]


def test_shared_folder(spark, monkeypatch):
    from tidemark.llm import common

    kept = common.materialise(spark.range(3), "t")
    path = common._WRITTEN[-1]
    assert kept.count() == 3 and path.startswith(spark.conf.get("spark.checkpoint.dir"))
    common.clear(spark)
    assert not common._WRITTEN
    with pytest.raises(Exception):
        kept.count()
    monkeypatch.setattr(type(spark.conf), "get", lambda self, name, default=None: None if name == "spark.checkpoint.dir" else "file:/w")
    assert common.shared_path(spark, "t").startswith("file:/w/tidemark-t-")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://x")
    with pytest.raises(RuntimeError):
        common.shared_path(spark, "t")


def test_near_deduplicate(spark):
    df = clashing(spark, docs(spark, [(1, "a b"), (2, "a b"), (3, None), (None, "a b")])).withColumns({"gone": F.lit("x"), "__gone": F.lit("x")})
    got = order_minhash.deduplicate(df)
    assert {v for r in got.collect() for c, v in r.asDict().items() if c not in ("doc_id", "text")} == {"x"}
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None"]


def test_bounds_and_banded_alignment_are_exact():
    rng = random.Random(8)
    rows = [order_minhash.shingles(t) for _, t in altered(8, 25)]
    for x, y in itertools.combinations(rows, 2):
        m = order_minhash.matches(x, y, 10**6)
        table = [0] * (len(y) + 1)
        for a in x.tolist():
            before = 0
            for j, b in enumerate(y.tolist(), 1):
                before, table[j] = table[j], before + 1 if a == b else max(table[j], table[j - 1])
        assert m == table[-1]
        exact = m / (len(x) + len(y) - m)
        assert (order_minhash.similarity(x, y, 0.8) >= 0.8) == (exact >= 0.8)
        p, q = (np.unpackbits(order_minhash.bitmap(order_minhash.labelled(v)).view(np.uint8)) for v in (x, y))
        most = min(len(x) - (p & ~q & 1).sum(), len(y) - (q & ~p & 1).sum())
        assert most >= m
    del rng


# PII


def test_pii_kinds_and_formats(spark):
    text = 'Mail bob.smith@example.com or BOB.smith@example.com, call +1 (499) 555-6503, card 4111 1111 1111 1111, ip 172.242.194.228, token = "1eb9c654e721b4f812088970e66a6345cee33dd6", Mr. John Smith, Anna Smith.'
    df = clashing(spark, docs(spark, [(1, text), (2, None), (3, ""), (4, "call +1 (499) 555-6503\x01 now"), (4, "plain"), (None, "x 172.242.194.228")]))
    got = {str(r.doc_id) + (r.text or "")[:1]: r for r in pii_surrogates.replaced(df, "k", count_col="found").collect()}
    out = got["1M"].text
    for secret in ("smith@", "6503", "4111 1111", "172.242", "1eb9c654", "John Smith", "Anna"):
        assert secret not in out
    assert got["1M"].found == 8 and got["2"].text is None and got["3"].text == "" and got["4p"].text == "plain"
    m = regex.fullmatch(r'Mail (\S+@\S+\.com) or (\S+@\S+\.com), call (\+1 \(\d{3}\) \d{3}-\d{4}), card (\d{4} \d{4} \d{4} \d{4}), ip ([\d.]+), token = "([0-9a-f]{40})", Mr\. (\w+) (\w+), (\w+) (\w+)\.', out)
    assert m and m[1] == m[2] and m[8] == m[10]
    assert m[3] in got["4c"].text and m[5] in got["Nonex"].text and "\x01" in got["4c"].text
    assert m[7] in pii_surrogates.GIVEN["latin", "m"].split() and m[9] in pii_surrogates.GIVEN["latin", "f"].split()
    digits = [int(c) for c in m[4] if c.isdigit()][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert pii_surrogates.replaced(df.limit(0), "k").count() == 0
    assert pii_surrogates.replaced(df, "other").where("doc_id = 1").first().text != out


def test_pii_collisions_are_drawn_again(spark, monkeypatch):
    real = pii_surrogates.surrogate
    monkeypatch.setattr(pii_surrogates, "surrogate", lambda e, key, attempt: F.when(attempt == 0, F.lit("198.51.100.1")).otherwise(real(e, key, attempt)))
    rows = [(i, f"ip 10.0.0.{i} and 10.0.1.{i}") for i in range(1, 6)] + [(9, "ip 10.0.0.1")]
    out = {r.doc_id: r.text.split()[1::2] for r in pii_surrogates.replaced(docs(spark, rows), "k").collect()}
    flat = [x for i in range(1, 6) for x in out[i]]
    assert len(set(flat)) == 10 and out[9][0] == out[1][0]


def test_pii_families_and_numbers_are_drawn_again_as_one(spark, monkeypatch):
    real = pii_surrogates._hmac

    def same(key, label, message, attempt):  # the first draw of families and numbers is one for all
        return F.when((attempt == 0) & F.lit(label in ("family", "any")), F.lit("0" * 64)).otherwise(real(key, label, message, attempt))

    monkeypatch.setattr(pii_surrogates, "_hmac", same)
    rows = [
        (1, "Ms Smith|Anna Smith|Dr. Karl Smith|Alice Smith"), (2, "Ms Jones|Anna Jones|Mr Jones"), (3, "Mr Brown|Emma Brown"),
        (4, "+1 (499) 555-6503|+1 499 555 6503|+14995556503"), (5, "+1 (498) 555-6503|+1 498 555 6503"),
        (6, "4111 1111 1111 1111|4111-1111-1111-1111|4111111111111111"), (7, "4012 8888 8888 1881|4012888888881881"),
        (8, "DE89 3704 0044 0532 0130 00|DE89370400440532013000"),
    ]
    out = {r.doc_id: r.text.split("|") for r in pii_surrogates.replaced(docs(spark, rows), "k").collect()}
    families = [{x.split(" ")[-1] for x in out[i]} for i in (1, 2, 3)]
    assert all(len(f) == 1 for f in families) and len(set.union(*families)) == 3
    assert len(set(out[1])) == 4 and out[1][1].split()[0] == out[2][1].split()[0]
    numbers = [{"".join(c for c in x if c.isalnum()) for x in out[i]} for i in range(4, 9)]
    assert all(len(n) == 1 for n in numbers) and len(set.union(*numbers)) == 5
    for i, text in rows:
        if i > 3:
            assert ["".join(" " if c.isalnum() else c for c in x) for x in out[i]] == ["".join(" " if c.isalnum() else c for c in x) for x in text.split("|")]
    assert all(x.startswith("+1") for x in out[4] + out[5]) and all(x.startswith("DE") for x in out[8])


def test_pii_given_names_keep_apart():
    names = [set(n.split()) for n in pii_surrogates.GIVEN.values()]
    assert sum(map(len, names)) == len(set.union(*names))


def test_pii_texts_are_linear_and_columns_untouched(spark):
    size = 1_000_000
    odd = ["-" * size, "." * size, "a." * (size // 2), "x@" + "a." * 100_000 + "com", "token=" + "a" * size, "1 " * (size // 2), "a" * size + "@x.com", "A1 " * (size // 3), "Dr " * 100_000, "::" * 100_000, "f:" * 100_000]
    df = clashing(spark, docs(spark, list(enumerate([*odd, "mail a.b@c.example.com"]))))
    df = df.select("*", *(F.lit("mine").alias(n) for n in ("parts", "tag", "attempts", "h", "m", "held", "entity", "e", "out")))
    began = time.time()
    got = pii_surrogates.replaced(df, "k").collect()
    assert time.time() - began < 90
    assert {tuple(v for c, v in r.asDict().items() if c not in ("doc_id", "text")) for r in got} == {tuple(v for c, v in df.first().asDict().items() if c not in ("doc_id", "text"))}
    out = {r.doc_id: r.text for r in got}
    assert all(out[i] == odd[i] for i in (0, 1, 2)) and len(out[5]) == size and "a" * 100 not in out[4] and "a.b@" not in out[11]
    with pytest.raises(ValueError):
        pii_surrogates.replaced(df, "")


def test_pii_scripts_capitals_and_addresses(spark):
    text = "Dr Παπαδόπουλος|Иван Петров|ANNA SMITH|Anna Smith|2001:db8::8a2e:370:7334|2001:DB8:0:0:1:2:3:4|at 10:30:45|std::vector|face::add"
    out = pii_surrogates.replaced(docs(spark, [(1, text)]), "k").first().text.split("|")
    assert regex.fullmatch(r"Dr \p{Greek}+", out[0]) and out[0] != text.split("|")[0]
    assert regex.fullmatch(r"\p{Cyrillic}+ \p{Cyrillic}+", out[1]) and out[1].split()[0] in pii_surrogates.GIVEN["cyrillic", "m"].split()
    assert out[2].isupper() and out[2] == out[3].upper() and out[3] != "Anna Smith" and out[3].split()[0] in pii_surrogates.GIVEN["latin", "f"].split()
    assert regex.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}", out[4]) and out[4] != text.split("|")[4]
    assert regex.fullmatch(r"[0-9A-F]{4}:[0-9A-F]{3}(:[0-9A-F]){6}", out[5]) and out[6:] == text.split("|")[6:]


def test_pii_equals_the_rules_on_real_rows(spark, sf="/root/testdata/sf0.01"):
    """Every match of the pattern, found here without Spark, is replaced: one for one, apart, in its format; nothing else changes."""
    pattern = regex.compile(pii_surrogates.PATTERN.replace(r"\p{Is", r"\p{"))
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in pii_surrogates.replaced(docs(spark, list(rows.items())), "k").collect()}
    forms, names = {}, set()
    for i, text in rows.items():
        at, rest = 0, got[i]
        for m in pattern.finditer(text):
            between = text[at : m.start()]
            assert rest.startswith(between)
            rest = rest[len(between) :]
            at = m.end()
            follows = text[at : m.end() + 1]
            new = pattern.match(rest)
            new = new[0] if new else rest[: len(m[0])]
            if "@" in m[0]:
                new = regex.match(r"[^\s@]+@[\w.-]*?" + regex.escape(m[0][m[0].rindex(".") :]), rest)[0]
            assert new != m[0] and forms.setdefault(m[0], new) == new, (m[0], new, follows)
            names.add(m[0])
            digits = lambda x: regex.sub("[0-9]", "0", x)
            if regex.fullmatch(r"[\d ()+-]+", m[0]):
                assert digits(new) == digits(m[0])
            rest = rest[len(new) :]
        assert rest == text[at:]
    assert len(forms) > 20 and len(set(forms.values())) == len(forms) and not names & set(forms.values())


def test_pii_has_no_python(spark, sf):
    df = pii_surrogates.replaced(spark.read.parquet(f"{sf}/documents.parquet"), "k")
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# pipeline


def test_pipeline_equals_its_parts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    kept = d
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == d.columns, name
        kept = spark.createDataFrame(out.toPandas(), d.schema)
        counts.append(kept.count())
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert counts[2] == counts[3] == len({t.lower() for _, t in texts}) <= counts[1] <= counts[0] <= d.count()
    assert len(set(near_classes(texts).values())) == len(texts)
    pieces = collections.Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == {i for i, _ in texts}
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == len(pieces)
