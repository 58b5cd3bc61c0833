import math
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from larkspur.llm import html_blocks, html_training, mixing, vector_search, weak_labels
from larkspur.llm import sentencepiece_codec as sp
from larkspur.llm.queries import model_bytes

from .fixtures import edge_documents, frame, words

# mixing


def plain_mix(rows, ratio, repeats, budget_ratio=1.0):
    n = {r[0]: len(words(r[1])) for r in rows}
    tokens, total = defaultdict(int), 0
    for r in rows:
        tokens[r[3]] += n[r[0]]
        total += n[r[0]]
    shares = {s: t / total for s, t in tokens.items() if t}
    entropy = lambda a: -sum((p**a / z) * math.log(p**a / z) for z in [sum(q**a for q in shares.values())] for p in shares.values())
    most = lambda a: max(p**a / p for p in shares.values()) / sum(p**a for p in shares.values()) * budget_ratio
    a = 1.0
    while a > 0 and entropy(a) < ratio * math.log(len(shares)):
        a -= 1e-4
    while a < 1 and most(a) > repeats:
        a += 1e-4
    z = sum(p**a for p in shares.values())

    def u(epoch, doc):
        h = xxhash.xxh64_intdigest(struct.pack("<i", 7), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", epoch), h)
        return (xxhash.xxh64_intdigest(struct.pack("<q", doc), h) >> 11) / float(1 << 53)

    used = Counter()
    for s, p in shares.items():
        budget = int(p**a / z * budget_ratio * total)
        full, rest = divmod(budget, tokens[s])
        mine = sorted((u(full, r[0]), r[0]) for r in rows if r[3] == s)
        for e in range(full):
            used.update((d, e) for _, d in mine)
        run = 0
        for i, (x, d) in enumerate(mine):
            run += n[d]
            same = sum(n[e] for y, e in mine[i + 1 :] if y == x)
            if run + same > rest:
                break
            used[(d, full)] += 1
    return used, {s: p**a / z for s, p in shares.items()}


def test_mixing_equals_plain(spark):
    rows = edge_documents()
    for ratio, repeats in ((0.97, 4.0), (0.999, 1.05)):
        got = mixing.mix(frame(spark), entropy_ratio=ratio, max_repeats=repeats, block_tokens=500)
        used, weights = plain_mix(rows, ratio, repeats)
        have = Counter((r["doc_id"], r["mix_epoch"]) for r in got.collect())
        off = sum(((have - used) + (used - have)).values())
        assert off <= 2  # the plain exponent is only good to 1e-4
        tokens = defaultdict(int)
        for r in got.collect():
            tokens[r["source"]] += r["mix_tokens"]
        total = sum(len(words(r[1])) for r in rows)
        for s, w in weights.items():
            assert tokens[s] <= w * total + 2
    assert got.columns == [*frame(spark, []).columns, "mix_tokens", "mix_epoch", "mix_block"]
    assert mixing.mix(frame(spark, [])).count() == 0


def test_blocks_hold_the_mixture(spark):
    rows = [(i, "w " * 10, "en", "big" if i % 3 else "small", 1, 1) for i in range(3000)]
    got = mixing.mix(frame(spark, rows), entropy_ratio=1.0, block_tokens=3000).collect()
    per = defaultdict(Counter)
    for r in got:
        per[r["mix_block"]][r["source"]] += r["mix_tokens"]
    assert len(per) == 10
    assert all(0.35 < c["small"] / (c["small"] + c["big"]) < 0.65 for c in per.values())


# vectors


def test_vectors_are_found(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((900, 8)).astype(np.float32)
    m[100:400] = m[5]  # a third are copies
    rows = [(i * 5, [float(x) for x in v], 1) for i, v in enumerate(m)]
    rows += [(10001, None, 1), (10002, [], 1), (10003, [0.0] * 8, 1), (10004, [float("nan")] * 8, 1), (10005, [1.0] * 3, 1), (10006, [None] * 8, 1), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    got = defaultdict(list)
    for r in vector_search.nearest(df, target=0.99).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    ids, x = np.arange(900) * 5, m.astype(np.float64)
    hits = 0
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    for q, found in got.items():
        s = x @ x[q // 5]
        want = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        assert [r for *_, r in found] == list(range(1, 21)) and q not in [v for v, *_ in found]
        assert np.allclose([sc for _, sc, _ in found], [s[v // 5] for v, *_ in found], rtol=1e-12)
        assert all((a[1], -a[0]) >= (b[1], -b[0]) or math.isclose(a[1], b[1]) for a, b in zip(found, found[1:]))
        hits += len(set(want) & {v for v, *_ in found})
    assert hits / (20 * len(got)) >= 0.9
    assert vector_search.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert vector_search.nearest(few).count() == 4


# pages


def test_held_out_pages_are_labelled():
    net = html_blocks.Labeller.load(html_blocks.model_bytes())
    blocks, pages = html_training.accuracy(net, html_training.samples(300, 4242))
    assert blocks > 0.99 and pages > 0.95


def test_gradients_are_right():
    net = html_blocks.Labeller(seed=1)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    data = html_training.samples(6, 3)[:3]
    xs, ys = [html_blocks.inputs(x) for x, _ in data], [y for _, y in data]
    _, g = net.gradients(xs, ys)
    rng = np.random.default_rng(0)
    for k, w in net.w.items():
        i = tuple(rng.integers(0, s) for s in w.shape)
        old = w[i]
        w[i] = old + 1e-3
        up, _ = net.gradients(xs, ys)
        w[i] = old - 1e-3
        down, _ = net.gradients(xs, ys)
        w[i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-3


def test_extraction_of_edge_pages(spark):
    good = "<html><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>Ti&amp;tle</h1><p>One  two\n three.<br>four<p>Next <b>bold</b> one.</article><div class='comments'><p>Nice post!</p></div><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", good, 7), (2, None, None, 7), (3, "u", "", 7), (4, "u", "<<<>>&&#xZZ;", 7), (5, "u", "<b>" * 3000 + "x", 7), (6, "u", "<div>" * 3000, 7), (1, "u", good, 7)]
    out = html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == 7
    assert got[1]["text"] == "Ti&tle\n\nOne two three. four\n\nNext bold one." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == ""
    assert html_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# tokens


def test_segments_of_a_batch_equal_those_of_a_pattern():
    import re

    codec, m = sp.Codec(model_bytes()), sp.MARK
    plain = ["", m, m * 7, f"a{m}b", f"{m}a{m}{m}{m}b{m}c{m}{m}", f"\0{m}\0a\1", "x", f"{m}ä\n{m}🙂{m}"]
    assert codec.segments(plain).to_pylist() == [re.findall(f"{m}*[^{m}]+|{m}+", t) for t in plain]
    ids, at, good = codec.encode([t.replace(m, " ") for t in plain])
    assert len(at) == len(plain) + 1 and good.all()
    assert not codec.spell(ids[at[3] : at[4]], np.array([0, at[4] - at[3]]), ["other"])[0]


def test_codec_equals_the_original(spark):
    codec = sp.Codec(model_bytes())
    assert codec.by_word
    texts = [r[1] or "" for r in edge_documents()] + list(sp.PROBES) + ["▁a ▁▁ b", "a   b    c     d", " lead", "trail ", "\x00\x01", "<s>", "é" * 2000]
    codec.verify(texts)
    ids, at, good = codec.encode(texts)
    for i, t in enumerate(texts):
        if "▁" not in t and "\x00" not in t:
            assert codec.decode(ids[at[i] : at[i + 1]].tolist()) == t and good[i]


def test_encode_documents_round_trip(spark):
    rows = edge_documents()
    out = sp.encode_documents(frame(spark), model_bytes())
    assert out.count() == len(rows) and out.filter("NOT round_trip").count() == 0
    back = {r["doc_id"]: r["text"] for r in sp.decode_documents(out, model_bytes()).collect()}
    assert back == {r[0]: r[1] or "" for r in rows}
    assert sp.encode_documents(frame(spark, []), model_bytes()).count() == 0


def _message(*parts):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("fallback", [0, 1])
def test_unigram_models_are_rebuilt(fallback):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] * fallback
    pieces += [("▁", -3.0, 1), ("▁the", -1.5, 1), ("th", -2.5, 1), ("e", -2.0, 1), ("▁h", -2.2, 1), ("a", -2.1, 1), ("t", -2.4, 1), ("h", -2.6, 1), ("at", -1.9, 1), ("▁hat", -1.7, 1)]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    data += _message((2, _message((3, 1), (35, fallback))), (3, _message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    codec = sp.Codec(data)
    codec.verify(["the hat", "  the   at ", "", "heat that", "tea"] + ["the zé🙂 hat"] * fallback)


# weak labels


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.7
    votes = np.zeros((20000, 4), int)
    for j, acc in enumerate((0.95, 0.85, 0.7, 0.6)):
        right = rng.random(20000) < acc
        votes[:, j] = np.where(rng.random(20000) < 0.2, 0, np.where(right == y, 1, 2))
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.LabelModel(kinds, counts.astype(float))
    assert np.allclose(model.accuracies(), (0.95, 0.85, 0.7, 0.6), atol=0.03)
    # as good as the best decision, which knows prior and accuracies
    odds = np.log(0.7 / 0.3) + sum(np.where(votes[:, j] == 1, 1, np.where(votes[:, j] == 2, -1, 0)) * np.log(a / (1 - a)) for j, a in enumerate((0.95, 0.85, 0.7, 0.6)))
    assert np.mean((model.posterior(votes) > 0.5) == y) > np.mean((odds > 0) == y) - 0.005


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = weak_labels.classify(spark.read.parquet(f"{d}/documents.parquet"))
    x = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    good, bad = [r["kept"] for r in x if r["quality"]], [r["kept"] for r in x if not r["quality"]]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_classifier_takes_edge_documents(spark):
    rows = edge_documents()
    got = weak_labels.classify(frame(spark)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    blank = {r[0] for r in rows if not words(r[1])}
    assert all(r["score"] == 0 and r["posterior"] == 0 and not r["kept"] for r in got if r["doc_id"] in blank)
    assert weak_labels.classify(frame(spark, [])).count() == 0


def test_an_omitted_head_end_tag_hides_nothing():
    from larkspur.llm.html_blocks import blocks

    body = "<p>First words of the text.<p>Second words of it."
    want = ["First words of the text.", "Second words of it."]
    for head in ("<head><title>T</title><meta charset=utf-8><body>", "<head><title>T</title>", "<head><style>x</style><noscript><link href=a></noscript>", "<head><title>T</title></head><body>", "<head><template><p>hidden</p></template><body>"):
        assert [b[1] for b in blocks("<html>" + head + body)] == want, head
    assert [b[1] for b in blocks("<head><title>T</title>Bare words.<p>More.")] == ["Bare words.", "More."]


def test_classifier_equals_a_plain_version(spark):
    """EM over the votes of all rows and the scorer's training set, each by loops over rows."""
    import pyarrow as pa
    import xxhash
    from pyspark.sql import functions as F

    from larkspur.llm.quality_rules import fit_references

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    docs = docs.union(spark.createDataFrame([(None, None, None), (None, "en", "few words"), (7, "en", ""), (3, "en", "copy copy"), (3, "en", "copy copy")], docs.schema))
    rows = docs.withColumn("key", F.xxhash64("doc_id", "lang", "text")).collect()
    refs = fit_references(docs)
    vote = lambda r: weak_labels.votes(weak_labels.measures(pa.array([r["text"] or ""], pa.large_string()), np.array([r["lang"]], object), refs))[0].astype(int)
    seen = [tuple(vote(r)) for r in rows]
    kinds = sorted(set(seen), key=lambda v: sum(x * 3**i for i, x in enumerate(v)))
    model = weak_labels.LabelModel(np.array(kinds), np.array([seen.count(k) for k in kinds], float))
    post = [float(model.posterior(np.array([v]))[0]) if words(r["text"]) else 0.0 for r, v in zip(rows, seen)]

    def bag(text):
        out, shapes, last = [], [], None
        for w in words(text):
            kind = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w]
            shape = "".join(c for i, c in enumerate(kind) if i == 0 or c != kind[i - 1])
            out.append(xxhash.xxh3_64_intdigest(w) % (weak_labels.BUCKETS - 1) + 1)
            shapes.append(0 if w == last else xxhash.xxh3_64_intdigest("shape " + shape) % (weak_labels.BUCKETS - 1) + 1)
            last = w
        return np.array(out + shapes, np.int64)

    able = sorted({(r["key"], r["doc_id"] or 0): i for i, r in enumerate(rows) if words(r["text"])}.items())[:50]
    w, b = weak_labels.train([bag(rows[i]["text"]) for _, i in able], np.array([post[i] for _, i in able]))
    score = [float(1 / (1 + np.exp(-(w[x].sum() / (len(x) / 2) + b)))) if len(x) else 0.0 for x in (bag(r["text"]) for r in rows)]
    got = sorted(((r["doc_id"] or -1, r["posterior"], r["score"], r["kept"]) for r in weak_labels.classify(docs, training_rows=50).collect()))
    want = sorted((r["doc_id"] or -1, p, s, bool(words(r["text"])) and s >= 0.5) for r, p, s in zip(rows, post, score))
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert x[0] == y[0] and abs(x[1] - y[1]) < 1e-9 and abs(x[2] - y[2]) < 1e-6 and x[3] == y[3]


def test_malformed_markup_is_read():
    from larkspur.llm.html_blocks import blocks

    assert [b[1] for b in blocks("<p>before<![foo[ x > after<p>then<svg><text>drawn</text></svg> end<p><object>inner</object><math><mi>x</mi></math>")] == ["before after", "thendrawn end", "innerx"]
    rng = np.random.default_rng(5)
    bits = ["<![foo[", "<![", "<!", "<!--", "-->", "<div", "<p>", ">", "</", "</p>", '<a href="', '"', "'", "&#", "&amp;", "&#x", "text ", "<?", "<script>", "</script>", "<svg>", "]]>", "<![CDATA[", "<title", "<head>", "<body>", "<template>", "</template>", "=", "/>", "<!DOCTYPE", "\0", "é"]
    for _ in range(3000):
        blocks("".join(rng.choice(bits, rng.integers(1, 30))))


def test_long_pages_and_long_blocks(spark):
    words_ = " ".join(f"wordly{i}, thing." for i in range(30000))
    many = "".join(f"<p>Some plain words of block {i}, and a few more of them here.</p>" for i in range(12000))
    deep = "<div>" * 20000 + "deep" + "</p>" * 20000
    rows = [(1, "u", f"<article><h1>Title here</h1><p>{words_}</p></article>", 7), (2, "u", f"<article>{many}</article>", 7), (3, "u", deep, 7), (4, "u", "<![foo[ x", 7)]
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()}
    assert got[1] == "Title here\n\n" + words_
    assert got[2].count("\n\n") == 11999


def test_a_page_written_by_hand():
    page = """<!doctype html><html lang=en><head><meta charset=utf-8><title>T</title><script>var a = "<p>no</p>";</script></head><body>
    <header class="site-header"><a href="/">Daily Courier</a></header><nav><ul><li><a href="/w">World</a><li><a href="/s">Sport</a></ul></nav>
    <div class="cookie-banner">We use cookies. <button>Accept</button></div>
    <main><article><h1>River path opens again</h1><p>The path along the river opened again on Monday, after two years of work.
    <p>Walkers &amp; cyclists may use it by day.<ul><li>Open from eight to six.<li>Dogs on a lead.</ul><div class="ad">Buy boots now</div><blockquote>It was worth it, said the mayor.</blockquote></article></main>
    <aside class="related"><h3>More</h3><a href="/x">Bridge closed</a></aside><section id="comments"><h3>2 comments</h3><div class="comment"><p>At last, I say!</p></div></section>
    <form action="/q"><label>Search</label><input><select><option>All</option></select></form><footer>&copy; 2024 Daily Courier. All rights reserved.</footer></body></html>"""
    net = html_blocks.Labeller.load(html_blocks.model_bytes())
    read = html_blocks.blocks(page)
    assert html_blocks.main_text(read, net.probabilities([read])[0]).split("\n\n") == [
        "River path opens again", "The path along the river opened again on Monday, after two years of work.", "Walkers & cyclists may use it by day.", "Open from eight to six.", "Dogs on a lead.", "It was worth it, said the mayor.",
    ]
