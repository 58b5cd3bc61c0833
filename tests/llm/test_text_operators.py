import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

from larkspur.llm import line_dedup, pii, quality_rules, simhash, substring_dedup

from .fixtures import SCHEMA, edge_documents, frame, words


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# line dedup


def plain_lines(rows, k):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    seen = Counter(x for r in rows for x in {key(line) for line in (r[1] or "").split("\n")} if x)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < k]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_line_dedup_equals_plain(spark):
    rows = edge_documents()
    got = rows_of(line_dedup.dedup_lines(frame(spark), min_docs=10), "doc_id", "text", "n_lines", "n_dropped")
    assert got == plain_lines(rows, 10)
    assert any(r[3] for r in got)


def test_line_dedup_keeps_columns_and_takes_an_empty_table(spark):
    out = line_dedup.dedup_lines(frame(spark, []))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_lines", "n_dropped"]
    assert out.count() == 0


def test_runs_are_levelled_and_known_lines_are_not_added(spark):
    from pyspark.sql import functions as F

    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    batch = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string").select(*line_dedup._hashes(F.col("k")))
    runs.add(batch("a", "a", "a", "b"))
    runs.add(batch("a", "a", "b", "c"))
    assert [len(x) for x in runs.levels] == [0, 1]
    merged = runs._open(runs.levels[1][0])
    assert sorted(r["n"] for r in merged.collect()) == [1, 2, 3]  # the second batch's a was known
    again = line_dedup.LineRuns(spark, min_docs=3, fanout=2, root=runs.root)  # a new driver goes on where the old one stopped
    assert again.levels == runs.levels and again.batches == 2
    again.add(batch("b"))
    assert again.frequent().count() == 2
    plan = runs._merged(runs.levels[1] * 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs are read by their buckets


# substring dedup


def plain_substrings(rows, k):
    docs = {}
    for r in rows:
        docs[r[0]] = words(r[1])
    seen, gone = {}, {}
    for d in sorted(docs):
        w = docs[d]
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in seen:
                gone.setdefault(d, set()).update(range(p, p + k))
            seen.setdefault(key, d)
    return sorted({(d, len(w), len(gone.get(d, ())), " ".join(x for i, x in enumerate(w) if i not in gone.get(d, ()))) for d, w in docs.items()})


def test_substring_dedup_equals_plain(spark):
    for window, base in ((20, 5), (7, 3)):
        got = rows_of(substring_dedup.dedup_substrings(frame(spark), window=window, base=base), "doc_id", "n_words", "n_removed", "kept")
        assert sorted(set(got)) == plain_substrings(edge_documents(), window)
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0


def test_substring_dedup_does_not_depend_on_the_filter(spark):
    a = rows_of(substring_dedup.dedup_substrings(frame(spark), filter_bits=64), "doc_id", "kept")
    assert a == rows_of(substring_dedup.dedup_substrings(frame(spark)), "doc_id", "kept")


# simhash


def plain_fingerprint(text, k):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode()) for x in words(text)]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps, distance):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in fps}


def test_simhash_equals_plain(spark):
    rows = edge_documents()
    fps = {r[0]: plain_fingerprint(r[1], 3) for r in rows}
    for distance, segments in ((3, 2), (3, 4), (7, 4)):
        classes = plain_classes(fps, distance)
        got = simhash.near_duplicates(frame(spark), distance=distance, segments=segments)
        assert rows_of(got, "doc_id", "fp", "component_id") == sorted((r[0], fps[r[0]] - (fps[r[0]] >> 63 << 64), classes[r[0]]) for r in rows)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_chains_are_one_component(spark):
    from larkspur.llm.common import components

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = dict((r[0], r[1]) for r in components(chain).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_keep_one_keeps_the_smallest_id(spark):
    rows = [(5, "a b c d e", "en", "s", 1, 1), (2, "a b c d e", "en", "s", 1, 1), (9, "totally other words here now", "en", "s", 1, 1)]
    assert rows_of(simhash.keep_one(frame(spark, rows)), "doc_id") == [(2,), (9,)]


def plain_similar(rows, least):
    """The smallest id of each row's class, by all pairs' five-word Jaccard similarity."""
    sets = {}
    for r in rows:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode()) for x in words(r[1])]
        sets[r[0]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    of = {d: d for d in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and of[i] != of[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((of[i], of[j]))
                of = {d: a if c == b else c for d, c in of.items()}
    return of


def test_keep_one_finds_copies_at_a_similarity_of_four_fifths(spark):
    r = random.Random(3)
    rows = []
    for i in range(40):
        text = [f"w{r.randrange(5000)}" for _ in range(300)]
        rows.append((i, " ".join(text), "en", "s", 1, 1))
        for k, n in enumerate((2, 4, 6, 9)):
            copy = list(text)
            for at in r.sample(range(10, 290), n):
                copy[at] = f"new{r.randrange(10**6)}"
            rows.append((100 + 10 * i + k, " ".join(copy), "en", "s", 1, 1))
    rows += [(1000 + k, " ".join([*[f"x{j}" for j in range(200)], f"end{k}"]), "en", "s", 1, 1) for k in range(60)]  # a large group
    of = plain_similar(rows, 0.8)
    kept = sorted(d for d, c in of.items() if d == c)
    assert rows_of(simhash.keep_one(frame(spark, rows)), "doc_id") == [(d,) for d in kept]
    bits = plain_classes({x[0]: plain_fingerprint(x[1], 3) for x in rows}, 3)
    assert len(kept) < len({c for c in bits.values()}) / 2  # three bits of 64 miss most of them
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_keep_one_in_a_group_whose_members_are_less_alike_than_their_centre(spark):
    r = random.Random(8)
    base = [f"c{i}" for i in range(150)]
    rows = [(0, " ".join(base), "en", "s", 1, 1)]
    for i in range(1, 120):
        copy = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 4, 6, 9])):
            copy[at] = r.choice([f"new{r.randrange(10**6)}", f"twin{at}"])
        rows.append((i, " ".join(copy[: r.choice([150, 150, 140, 125])]), "en", "s", 1, 1))
    rows += [(500 + i, " ".join(base[:60] + [f"z{i}x{k}" for k in range(r.choice([10, 60]))]), "en", "s", 1, 1) for i in range(30)]
    kept = sorted(d for d, c in plain_similar(rows, 0.8).items() if d == c)
    assert 5 < len(kept) < 140
    assert rows_of(simhash.keep_one(frame(spark, rows)), "doc_id") == [(d,) for d in kept]


def test_keep_one_finds_the_closest_copies_by_simhash(spark, monkeypatch):
    from larkspur.llm import near_copies

    monkeypatch.setattr(near_copies, "bands", lambda own: np.zeros(0, np.int64))  # fingerprints alone name candidates
    r = random.Random(6)
    rows = []
    for i in range(30):
        text = [f"w{r.randrange(50000)}" for _ in range(400)]
        copy = list(text)
        copy[r.randrange(10, 390)] = "new"
        rows += [(2 * i, " ".join(text), "en", "s", 1, 1), (2 * i + 1, " ".join(copy), "en", "s", 1, 1)]
    fps = {x[0]: plain_fingerprint(x[1], 5) for x in rows}
    kept = [d for d, c in plain_classes(fps, 3).items() if d == c]
    assert 30 <= len(kept) < 45
    assert rows_of(simhash.keep_one(frame(spark, rows)), "doc_id") == [(d,) for d in kept]


def test_frequencies_have_a_row_for_each_term_of_a_task(monkeypatch):
    import types

    import pyarrow as pa

    texts = [f"often name{i % 7} name{i % 7} (Often) w{i}" for i in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 10], pa.string())], ["text"]) for i in range(0, 300, 10)]
    every = types.SimpleNamespace(value=np.full(1 << 10, -1, np.int64).view(np.uint64))
    want = Counter(w for t in texts for w in set(t.lower().replace("(", "").replace(")", "").split()))
    for most, rows in ((1 << 17, len(want)), (20, 30 * 18)):
        monkeypatch.setattr(pii, "COUNTED", most)
        got = [(r["t"], r["n"]) for b in pii._frequencies(every)(iter(batches)) for r in b.to_pylist()]
        total = Counter()
        for t, n in got:
            total[t] += n
        assert total == want and len(got) <= rows


def test_sketches_differ_in_no_more_bits_than_their_sets():
    from larkspur.llm.near_copies import SKETCH, sketch

    r = np.random.default_rng(4)
    for n in (0, 1, 60, 400, 3 * SKETCH):
        one = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        for m in (0, 1, 40, 900):
            other = np.unique(np.concatenate((one[: max(0, len(one) - m // 2)], r.integers(0, 1 << 64, m, np.uint64))))
            bits = int(np.bitwise_count((sketch(one) ^ sketch(other)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(one, other)) and len(sketch(one)) == SKETCH // 64


def test_keep_one_loses_no_row_by_its_id(spark):
    copy, other = "one two three four five six seven", "a clean text of quite other words"
    rows = [(None, "no id but its own words here", "en", "s", 1, 1), (None, copy, "en", "s", 1, 1), (3, copy, "en", "s", 1, 1), (3, other, "en", "s", 1, 1)]
    rows += [(None, "only rows without ids hold this", "en", "s", 1, 1)] * 2 + [(8, other + "  ", "en", "s", 1, 1), (2, copy, "en", "s", 1, 1)]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in simhash.keep_one(frame(spark, rows)).collect())
    assert got == sorted([(0, "no id but its own words here"), (0, "only rows without ids hold this"), (2, copy), (3, other)])


# quality rules


def plain_base(text):
    w, text = words(text), text or ""
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(wins)
    cover = {i + j for i, x in enumerate(wins) if often[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    n = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def plain_kept(rows):
    """The verdict by the definition of the Jensen-Shannon distance, from counts over all rows."""
    kind = lambda c: None if c in " \t\n\x0b\f\r" else 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if ord(c) > 127 else 3 if c.isdigit() else 4 if c in ".!?" else 5 if c in ",;:'\"-()" else 6 if c in "#*$%&|<>" else 7
    langs = {r[2] for r in rows}
    chars = lambda t: Counter(k for k in map(kind, t or "") if k is not None)
    refs = {}
    for lang in langs:
        mine = [r for r in rows if r[2] == lang]
        common = [w for w, _ in sorted(Counter(x for r in mine for x in words(r[1])).items(), key=lambda x: (-x[1], x[0]))[:40]]
        c = sum((chars(r[1]) for r in mine), Counter())
        n = Counter(w if w in common else None for r in mine for w in words(r[1]))
        refs[lang] = (set(common), c, n)

    def far(a, b):
        sa, sb = sum(a.values()), sum(b.values())
        if not sa or not sb:
            return 0.0
        total = 0.0
        for k in set(a) | set(b):
            p, q = a[k] / sa, b[k] / sb
            m = (p + q) / 2
            total += (p * np.log2(p / m) if p else 0) / 2 + (q * np.log2(q / m) if q else 0) / 2
        return max(total, 0) ** 0.5

    out = {}
    for r in rows:
        common, c, n = refs[r[2]]
        base = plain_base(r[1])
        own = Counter(w if w in common else None for w in words(r[1]))
        out[r[0]] = not base[5] and not (base[1] >= 200 and (far(chars(r[1]), c) > 0.30 or far(own, n) > 0.42))
    return out


def test_quality_rules_equal_plain(spark):
    rows = edge_documents()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality_rules.quality_rules(frame(spark))
    assert rows_of(got, *names) == sorted((r[0], *plain_base(r[1])) for r in rows)
    kept = plain_kept(rows)
    assert {r["doc_id"]: r["kept"] for r in got.collect()} == kept
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0
    carried = quality_rules.quality_rules(frame(spark), carry=True)
    assert carried.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "kept"]
    assert {r["doc_id"]: r["kept"] for r in carried.collect()} == kept


def test_quality_rules_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).filter("NOT base_failed AND word_chars >= 200")
    x = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in x]) > 0.98


# personal data

TEXTS = [
    "mail a.b+c@x-y.example.com, or x@y (no), b@c.d.e. and @no.one q@r.s@t.u",
    "ip 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 1.2.3 and 001.002.003.004",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 123456789012 5500000000000004x",
    "call +1 (487) 555-7209 or +49.30.1234567, +12 no, +1234567890123456 and +++1 234 567 890",
    None, "", "ü" * 50 + " a@b.co " + "9" * 40, "1" * 20000, "a" * 20000 + "@b.c",
]


def plain_spans(text):
    text, out = text or "", []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m[0])
            ok = True
            if k == 1:
                ok = all(int(x) <= 255 for x in m[0].split("."))
            if k == 2:
                d = [int(c) for c in digits[::-1]]
                ok = 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0
            if k == 3:
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    for t in TEXTS[:7]:
        assert pii.base_spans(t or "") == plain_spans(t), t
    assert pii.base_spans(TEXTS[8]) == [(0, 0, 20004)]


def test_terms_that_disclose_an_entity_are_found(spark):
    rows = [(i, f"filler{i} words here Zorbax agent secret@corp.example.com writes text{i} again", "en", "s", 1, 1) for i in range(6)]
    rows += [(100 + i, f"plain words here writes text{i} again agent nothing", "en", "s", 1, 1) for i in range(300)]
    rows += [(900, None, None, None, None, None), (901, "", None, None, None, None)]
    found = pii.find_personal_data(frame(spark, rows))
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    text = dict((r[0], r[1]) for r in rows)
    terms = {text[i][s["start"] : s["end"]] for i, r in got.items() for s in r["spans"] if s["k"] == pii.TERM}
    assert terms == {"Zorbax"}  # common words near the address reveal nothing, single ones are no evidence
    assert all(len(got[i]["base"]) == 1 and len(got[i]["spans"]) == 2 for i in range(6))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, rows), found).collect()}
    assert clean[0] == "filler0 words here [TERM] agent [EMAIL] writes text0 again"
    assert clean[100] == text[100]
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_copies_are_no_evidence(spark):
    rows = [(i, "the same words near Quux a@b.example.com every time", "en", "s", 1, 1) for i in range(20)]
    rows += [(100 + i, f"other text{i}", "en", "s", 1, 1) for i in range(100)]
    assert all(len(r["spans"]) == len(r["base"]) for r in pii.find_personal_data(frame(spark, rows)).collect())


def test_terms_count_over_whole_documents_and_are_marked_everywhere(spark):
    gap = lambda i: " ".join(f"pad{i}x{k}" for k in range(300))
    rows = [(i, f"(Quibbler) {gap(i)} sincerely yours me@corp.example.com {gap(i)} quibbler!", "en", "s", 1, 1) for i in range(4)]
    rows += [(50, "nobody but Quibbler is here", "en", "s", 1, 1)]
    rows += [(100 + i, f"sincerely yours, other{i}", "en", "s", 1, 1) for i in range(300)]
    text = dict((r[0], r[1]) for r in rows)
    got = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["k"] == pii.TERM] for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert {d: t for d, t in got.items() if t} == {**{i: ["Quibbler", "quibbler"] for i in range(4)}, 50: ["Quibbler"]}


def test_contract_query_digests(spark, sf_dir):
    from larkspur.llm.queries import op6_personal_data

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op6_personal_data(spark, sf_dir).collect():
        spans = plain_spans(docs[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in spans) for k in range(4)]


def test_references_are_exact_however_rows_are_dealt(spark):
    r = random.Random(9)
    zipf = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(zipf, [1 / (k + 1) for k in range(300)], k=400)), "en", "s", 1, 1) for i in range(80)]
    rows += [(100 + i, " ".join(f"flat{r.randrange(4000)}" for _ in range(600)), "fl", "s", 1, 1) for i in range(40)]  # no word is one in 2000
    rows += [(200, "null language", None, "s", 1, 1), (201, "", "", "s", 1, 1), (202, "empty language", "", "s", 1, 1)]
    want = {}
    for lang in ("en", "fl", None, ""):
        n = Counter(w for x in rows if x[2] == lang for w in words(x[1]))
        want[lang] = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:40]
    for parts in (1, 64):
        refs = quality_rules.fit_references(frame(spark, rows).repartition(parts))
        assert {k: list(zip(v["words"], v["counts"])) for k, v in refs.items()} == want
        few = quality_rules.fit_references(frame(spark, rows).repartition(parts), most=3)  # every language by the full count
        assert {k: v["words"] for k, v in few.items()} == {k: [w for w, _ in v] for k, v in want.items()}


def test_odd_column_names_are_carried(spark):
    rows = frame(spark).selectExpr("*", "1 as `my col`", "2 as `a.b`", "3 as `row`", "4 as `c0`")
    got = quality_rules.quality_rules(rows, carry=True)
    assert got.columns == [*rows.columns, "kept"]
    assert {tuple(r[c] for c in ("my col", "a.b", "row", "c0")) for r in got.collect()} == {(1, 2, 3, 4)}
    assert sorted((r["doc_id"], r["text"] or "", r["text"] is None) for r in got.collect()) == sorted((r[0], r[1] or "", r[1] is None) for r in edge_documents())


def test_operators_on_whole_rows_take_any_column_name(spark):
    from larkspur.llm import mixing

    names = ["my col", "a.b", "__id", "__source", "__drop", "__row", "row", "c0", "u", "component"]
    rows = frame(spark).selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(names)])
    for got, more in ((mixing.mix(rows), list(mixing.ADDED)), (line_dedup.dedup_lines(rows), ["n_lines", "n_dropped"]), (simhash.keep_one(rows), []), (pii.sanitise(rows, pii.find_personal_data(rows)), [])):
        assert got.columns == rows.columns + more
        assert {tuple(r[c] for c in names) for r in got.collect()} == {tuple(range(len(names)))}


def test_very_long_digit_runs_and_texts(spark):
    assert pii.base_spans(TEXTS[7]) == plain_spans(TEXTS[7]) == []
    text = "word " * 200_000 + "a@b.example.com"
    got = pii.find_personal_data(frame(spark, [(1, text, "en", "s", 1, 1), (2, None, "en", "s", 1, 1)])).collect()
    assert {r["doc_id"]: [(s["start"], s["k"], s["end"]) for s in r["base"]] for r in got} == {1: [(1_000_000, 0, 1_000_015)], 2: []}
