"""The training-data operators: odd inputs, and results against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import ann, brown_lm, cotrain, decontam, html_extract, minhash, packing, pii, rlindex, warc
from corpusloom.llm.common import stored, workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, words string"
VOCABULARY = ["alpha", "beta", "Gamma", "delta", "éta", "zeta", "42", "x-y", "the", "of"]


def docs_of(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(n))
    base = [prose(120) for _ in range(6)]
    near = [" ".join(w if rng.random() > 0.03 else "changed" for w in b.split()) for b in base for _ in range(4)]
    passage = prose(90)
    return [None, "", " \n\t", "one", "two words", *base, *near, base[0], base[0], prose(4) + " " + passage + " " + prose(9), prose(30) + " " + passage, "a" * 1500, "ab" * 700, prose(20_000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return docs_of(spark, texts)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_1_archive(spark):
    rows = [(3, "u", "<p>é</p>", 1), (1, "u", "<p>é</p>", 2), (2, None, None, 3), (5, "v", "", 4), (7, "w", "x" * 100_000, 5), (None, "z", "<p>é</p>", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    path = workspace(spark, "test-warc")
    warc.write_archive(pages, path)
    got = {r.page_id: r for r in warc.archive_report(spark, path).collect()}
    assert len(got) == len(rows)
    for page, _, body, _ in rows:
        raw = (body or "").encode()
        own = [p for p, _, b, _ in rows if (b or "") == (body or "") and p is not None]
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if page == max(own) else ("revisit", max(own)))
    records = {r.record_id: bytes(r.record) for r in warc.read_records(spark, path).collect()}
    assert records[7].startswith(b"WARC/1.1\r\n") and records[7].endswith(b"x" * 100_000 + b"\r\n\r\n")
    assert records[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    small = workspace(spark, "test-warc")
    warc.write_archive(pages, small, min_bytes=5)
    assert {r.page_id for r in warc.archive_report(spark, small).filter("record_type = 'response'").collect()} == {2, 3, 5, 7}
    empty = workspace(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([], pages.schema), empty)
    assert warc.archive_report(spark, empty).count() == 0


def test_2_language_model(spark, docs, texts, none):
    got = {r.doc_id: r for r in brown_lm.score_documents(docs, classes=4, head_words=50).collect()}
    words = lambda t: (t or "").encode().lower().split()
    training = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            training.update([*words(t), b"\0end"])
    n, v = sum(training.values()), len(training)
    for i, t in enumerate(texts):
        own = [*words(t), b"\0end"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(training[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((training[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert r.score < 0
    assert brown_lm.score_documents(none).count() == 0
    held = brown_lm.score_documents(docs_of(spark, [None, "a b"]).withColumn("doc_id", F.lit(1).cast("long")).filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 1))
    assert all(r.score == r.base_score for r in held.collect())


def test_2_model_sums_to_one():
    chars = brown_lm.char_model(brown_lm.byte_pairs([b"ab", b"c"]))
    assert (10**chars).sum(axis=1) == pytest.approx(np.ones(257))
    model = brown_lm.ClassModel(30, 9, 4, np.array([10.0, 16.0]), np.array([3.0, 5.0]), chars)
    model.fit_transitions(np.array([[3, 4, 0, 3], [5, 6, 0, 5], [0, 0, 0, 0], [2, 2, 0, 0]], float))
    p = 10**model.log_p
    known = 1 - brown_lm.DISCOUNT * model.sizes / model.totals
    assert (p[:, :2] @ known + p[:, 2] + p[:, 3]) == pytest.approx(np.ones(4))


def test_2_scores_by_hand(spark, docs, texts):
    trained = brown_lm.train(docs, classes=4, head_words=50)
    own = {bytes(r.word): (r.n, r["class"]) for r in brown_lm.word_classes(trained.places, trained.classes).collect()}
    words = lambda t: (t or "").encode().lower().split()
    training = [words(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    assert {w: n for w, (n, _) in own.items()} == collections.Counter(w for t in training for w in t)
    k = trained.model.k
    cls = {w: c for w, (_, c) in own.items()}
    pairs, size, tokens = np.zeros((k + 1, k + 1)), np.zeros(k), np.zeros(k)
    for t in training:
        row = [k, *(cls[w] for w in t), k]
        for a, b in zip(row, row[1:]):
            pairs[a, b] += 1
    for n, c in own.values():
        size[c] += 1
        tokens[c] += n
    bigrams = collections.Counter((a, b) for w in own for a, b in zip([256, *w], [*w, 256]))
    after = collections.Counter()
    for (a, _), n in bigrams.items():
        after[a] += n
    letter = lambda a, b: (bigrams[a, b] + 1) / (after[a] + (256 if a == 256 else 257))
    prior = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * (k + 1))
    step = lambda a, b: prior[b] if a is None else (pairs[a, b] + (k + 1) * prior[b]) / (pairs[a].sum() + k + 1)
    got = {r.doc_id: r.score for r in trained.scores().collect()}
    for i, t in enumerate(texts):
        total, before = 0.0, k
        for w in words(t):
            if w in own:
                n, c = own[w]
                total += math.log10(step(before, c) * (n - 0.5) / tokens[c])
                before = c
            else:
                total += math.log10(sum(step(before, c) * (0.5 * size[c] / tokens[c] if tokens[c] else 1.0) for c in range(k)))
                total += sum(math.log10(letter(a, b)) for a, b in zip([256, *w], [*w, 256]))
                before = None
        assert got[i] == pytest.approx(total + math.log10(step(before, k)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=12, max_size=60), st.integers(0, 2))
def test_2_gains_are_exact(tokens, shift):
    # A word that never stands next to itself: gains are the objective's differences.
    k, end = 3, 4
    tokens = [t for a, t in zip([None, *tokens], tokens) if not (t == a == 0)]
    own = [shift, *(t % k for t in range(1, 6))]

    def table_of(own):
        code = [end, *(own[t] for t in tokens), end]
        out = np.zeros((5, 5))
        np.add.at(out, (code[:-1], code[1:]), 1)
        return out

    f = lambda t: brown_lm.xlogx(t).sum() - brown_lm.xlogx(t.sum(axis=0)).sum() - brown_lm.xlogx(t.sum(axis=1)).sum()
    code = [end, *(own[t] for t in tokens), end]
    at = [i + 1 for i, t in enumerate(tokens) if t == 0]
    left, right = (np.bincount([code[i + d] for i in at], minlength=5)[None].astype(float) for d in (-1, 1))
    gain = brown_lm.gains(left, right, np.array([shift]), table_of(own), k)[0]
    want = [f(table_of([c, *own[1:]])) for c in range(k)]
    assert gain - gain[0] == pytest.approx(np.array(want) - want[0], abs=1e-3)


def test_2_exchange_finds_classes():
    rng = random.Random(1)
    groups = [["a", "b", "c"], ["x", "y", "z"]]
    words = [w for g in groups for w in g]
    counts = np.zeros((8, 8))
    for _ in range(4000):
        k = rng.randrange(2)
        counts[words.index(rng.choice(groups[k])), words.index(rng.choice(groups[1 - k]))] += 1
    own, _ = brown_lm.exchange(counts, 2)
    assert len(set(own[:3])) == 1 and len(set(own[3:])) == 1 and own[0] != own[3]


def test_2_all_words_are_exchanged(spark):
    # Two kinds of words take turns, and only "the" is frequent: tail words meet tail words alone.
    rng = random.Random(4)
    kinds = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]]
    texts = [" ".join(["the"] * 3 + [rng.choice(kinds[j % 2]) for j in range(60)]) for _ in range(200)]
    trained = brown_lm.train(docs_of(spark, texts), classes=4, head_words=6)
    own = {bytes(r.word): r["class"] for r in brown_lm.word_classes(trained.places, trained.classes).collect()}
    assert len(own) == 61 and max(trained.information) > 0.5  # a pass that lowers it is taken back
    by = {kind: {c for w, c in own.items() if w[:1] == kind} for kind in (b"a", b"b")}
    assert not by[b"a"] & by[b"b"]


def test_3_quality(spark, none):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        body = [rng.choice(VOCABULARY) + rng.choice("abcdefgh") for _ in range(60)]
        kind = i % 5
        if kind == 0:
            body = [w.upper() + "!!" for w in body]
        if kind == 1:
            body[rng.randrange(60)] = rng.choice(["nastyword", "rudeword"])
        rows.append((i, " ".join(body), "en", "s", 300))
        labels.append((i, int(kind != 0), int(kind == 1)))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), (900, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    truth = spark.createDataFrame([r for r in labels if r[0] < 300], "doc_id long, quality int, toxic int")
    model = cotrain.fit(docs, truth)
    got = {r.doc_id: r.kept for r in cotrain.score(docs, model).collect()}
    right = sum(got[i] == (q == 1 and t == 0) for i, q, t in labels if i >= 300)
    assert right >= 95 and len(got) == 402
    kept = cotrain.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())
    assert all(r.kept for r in cotrain.score(docs, cotrain.fit(docs, truth.limit(0))).collect())
    assert cotrain.score(none, cotrain.fit(none, truth)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


@settings(max_examples=300, deadline=None)
@given(st.text("ab.@%+-_ 0123456789()é", max_size=60))
def test_4_base_spans(text):
    found = {}
    for kind, pattern in PATTERNS.items():
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda m: 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 8 <= len(digits(m)) <= 15}[kind]
        found[kind] = [m.span() for m in re.finditer(pattern, text) if ok(m)]
    assert pii.base_spans(text) == found


def test_4_personal_data(spark, none):
    texts = [f"call +1 (555) 201-33{i:02d} or {i}.x@mail.example.com at 10.0.0.{i} then 4111111111111111 ok" for i in range(60)]
    texts += ["call +1 (555) 201-3344 now, later 555-201-3344 it is", None, "", "9" * 20_000, "plain"]
    docs = docs_of(spark, texts)
    model = pii.fit(docs)
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    assert (got[3].n_email, got[3].n_ip, got[3].n_card, got[3].n_phone) == (1, 1, 1, 1)
    assert got[60].n_added >= 1 and got[60].spans.startswith("phone:5:22")
    assert got[61].spans == "" and got[61].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert out[60].text == "call [PHONE] now, later [PHONE] it is" and out[60].n_chars == len(out[60].text)
    assert out[61].text is None and out[64].text == "plain" and pii.redact(docs, model).columns == docs.columns
    assert pii.find(none, pii.fit(none)).count() == 0


def test_4_labels_reach_distant_mentions():
    text = "call +1 (555) 201-3344 now" + ", later 555-201-3344 it is" * 30
    spans = pii.base_spans(text)
    model = pii.SkipChainCrf(["bias"])
    model.skip = 9 * np.eye(len(pii.LABELS))  # only mentions of the same number speak
    assert len(pii.added_spans(text, spans, model)["phone"]) == 30


def test_4_learns_from_every_token(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii.SkipChainCrf, "train", classmethod(lambda cls, graphs: seen.extend(graphs)))
    text = " ".join(f"word{i} and" for i in range(70)) + " +1 (555) 201-3344" + " " * 90 + "9.9.9.9"
    pii.fit(docs_of(spark, [text]))
    whole = pii.Graph(text, pii.base_spans(text))
    assert len(whole.at) > 70 and (seen[0].features, seen[0].chain, seen[0].skip) == (whole.features, whole.chain, whole.skip)
    assert seen[0].known.tolist() == whole.known.tolist() and len(seen) == 2


def brute_windows(documents, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = {}
    for i, t in enumerate(documents):
        w, hit, found = words(t), set(), set()
        for item, body in items:
            b = words(body)
            n = min(10, len(b))
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item)
        ids = sorted(str(x) for x in found)
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def test_5_decontamination(spark, none):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(1, prose(25)), (2, "Éta zeta; ALPHA"), (3, None), (4, "..."), (5, "beta"), (5, "beta"), (6, prose(10))]
    texts = [None, "", "beta", prose(50), f"{prose(3)} {items[0][1]} {prose(4)}", items[0][1].upper().replace(" ", ", "), "Éta-zeta-alpha", "éta zeta alpha", items[6][1] * 2, prose(9)]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(docs, bench).collect()}
    assert got == brute_windows(texts, items)
    assert decontam.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(docs.union(docs), bench).count() == 2 * len(texts)
    plan = decontam.decontaminate(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    terms = spark.createDataFrame([("alpha", 1), ("beta", 2)], "term string, term_id long")
    near = decontam.proximity_matches(decontam.build_postings(docs_of(spark, ["alpha x beta", "alpha x x x beta"]), terms), terms, "alpha", "beta", 2)
    assert [r.doc_id for r in near.collect()] == [0]
    # Dropping the second list leaves more candidates.
    windows = decontam.test_windows(bench.filter("item_id = 6"))
    vocabulary = spark.createDataFrame([(t, i + 1) for i, t in enumerate(sorted({w for r in windows.collect() for w in r.win}))], "term string, term_id long")
    postings = stored(decontam.build_postings(docs, vocabulary), workspace(spark, "test-postings"))
    counts = postings.groupBy("term_id").agg(F.count("*").alias("n"))
    chosen = spark.createDataFrame(decontam.rarest_first(windows, vocabulary, counts).collect(), "win_id long, win array<string>, places array<struct<n:long,term_id:long,o:int>>")
    first, second = (decontam._starts(postings, chosen, n) for n in (0, 1))
    at = ["win_id", "doc_id", "text_hash", "start"]
    both = first.join(second, at, "left_semi")
    assert decontam.phrase_matches(postings, chosen, workspace(spark, "test-decontam")).count() <= both.count() < first.count()


def test_6_html(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a> <a>News</a></nav><div class="top ad">Buy the best of it now</div>
    <article><h1>A&nbsp;title &amp; more</h1><p>It is the first of the paragraphs that we have in here and it is <b>long</b>.<br>
    <p>Short.<p>x<ul class="related"><li><a>One link</a></ul><p>And this is the last of the texts, as it was said before in the other one.</article>
    <aside>Of the side and the rest of it</aside><div id="comments"><p>I am of the opinion that this is the best of all the things here.</p></div><script>var a="<p>no</p>"</script><footer>&copy; the firm</footer></body></html>"""
    want = "A title & more\nIt is the first of the paragraphs that we have in here and it is long.\nShort.\nx\nAnd this is the last of the texts, as it was said before in the other one."
    assert html_extract.main_text(page) == want
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>It is the one of the texts that we have here and it is plain <!-- cut"), (5, "u", "<" * 500), (6, "u", page)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert got[1].text == got[6].text == want and got[1].n_chars == len(want) and got[2].text == got[3].text == "" and got[3].url is None
    assert got[4].text == "It is the one of the texts that we have here and it is plain"


def brute_groups(texts, width):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    low = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    return {i: (len(s), low[i], low[i] == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width", [2, 5])
def test_7_near_duplicates(docs, texts, none, width):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width).collect()}
    assert got == brute_groups(texts, width)
    assert minhash.near_duplicates(none).count() == 0


def test_7_group_around_a_threshold(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for n in range(90):
        words = list(base)
        for k in rng.sample(range(150), 6 + n % 7):
            words[k] = f"n{n}x{k}"
        texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(spark, texts), 2).collect()}
    assert got == brute_groups(texts, 2)


def test_8_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 16)).astype(np.float32)
    v[50:90] = v[50]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0]), (1004, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, lambda c: c % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = v.astype(np.float64)
    hit = total = 0
    for q in range(0, 300, 20):
        s = (x * x[q]).sum(axis=1)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        hit += len({i for i, _ in got[q]} & set(best))
        total += 20
        assert [i for i, _ in got[q]] == sorted((i for i, _ in got[q]), key=lambda i: (-s[i], i))
        assert all(score == pytest.approx(s[i]) for i, score in got[q])
    assert hit / total >= 0.99 and len(got) == 15
    assert ann.nearest(df.filter("vec_id < 3"), lambda c: c % 20 == 0).count() == 2
    assert ann.nearest(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_9_added_tokens():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    encode, t = packing.load_encoder(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    pieces = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "Don't", "é", "12", "!"]
    texts = ["a<|endoftext|>b", *("".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(500))]
    assert 50256 in encode(texts[0])
    assert [encode(x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_9_packing(docs, texts, none):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = packing.pack(docs, path, with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids
        assert all(r.length == 1024 for r in own[1:]) and [r.start for r in own] == [sum(q.length for q in own[:n]) for n in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:])) and own[-1].offset + own[-1].length <= 1024
    assert packing.pack(none, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_9_best_fit(lengths, bins):
    fit, fill, seen = packing.BestFit(20, bins), {}, []
    for n in lengths:
        number, at = fit.place(n)
        assert at == fill.get(number, 0) and at + n <= 20
        if at == 0:
            assert all(20 - fill[k] < n for k in [x for own in fit.bins.values() for x in own if x != number])
        fill[number] = at + n
        seen.append(number)
        assert fit.count == sum(map(len, fit.bins.values())) <= bins


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = {}
    for n, r in enumerate(raw):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[n] = (len(r), len(r) - len(left), runs, hashlib.sha256(left).hexdigest())
    return out


def test_10_repeats(docs, texts, none):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rlindex.remove_repeats(docs).collect()}
    assert got == brute_repeats(texts, 400)
    assert rlindex.remove_repeats(none).count() == 0


def test_10_crowded_anchor(docs, texts, monkeypatch):
    monkeypatch.setattr(rlindex, "ANCHOR_MOST", 2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rlindex.remove_repeats(docs).collect()}
    assert got == brute_repeats(texts, 400)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=20, max_size=60), min_size=1, max_size=6))
def test_10_index(strings):
    raw = [s.encode() for s in strings]
    seen = collections.Counter(r[i : i + 20] for r in raw for i in range(len(r) - 19))
    for r, (starts, ends) in zip(raw, rlindex.long_matches(raw, 20)):
        want, got = set(), set()
        for i in range(len(r) - 19):
            if seen[r[i : i + 20]] > 1:
                want |= set(range(i, i + 20))
        for a, z in zip(starts.tolist(), ends.tolist()):
            got |= set(range(a, z))
        assert got == want


def test_pipeline(spark, texts, tmp_path):
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    rng = random.Random(8)
    rows = [(100 + i, " ".join(rng.choice(VOCABULARY) + str(rng.randrange(90)) for _ in range(80)), "en", "s") for i in range(60)]
    rows += [(i, t, "en", "s") for i, t in enumerate(texts)] + [(300, "mail me at a.b@c.example.org or " + rows[0][1][:40], "en", "s")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    groups = brute_groups([r[1] for r in rows], 5)
    order = {i: r for i, r in enumerate(rows)}
    links = collections.defaultdict(list)
    for i, (_, low, _) in groups.items():
        links[low].append(order[i][0])
    keep = {min(g) for g in links.values()}
    hit = brute_windows([r[1] for r in rows], [(1, rows[5][1])])
    keep -= {order[i][0] for i, h in hit.items() if h[4]}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == keep
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "packing"]
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
