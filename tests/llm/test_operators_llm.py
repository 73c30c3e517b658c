"""Text operators on small fixtures: edge cases and brute-force comparisons."""

import hashlib
import os
import re
import sys
import zlib
from itertools import combinations

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from loanlens.llm import (  # noqa: E402
    decontaminate, language, line_dedup, mixing, pages, quality, simhash, suffix_repeats, token_ids, toxicity, url_filter)

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOREM = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near an old stone bridge at dawn"


def doc_rows():
    words = LOREM.split()
    base = " ".join(words * 1)
    return [
        (1, base + ".", "en", "b", 1), (2, base + ".", "en", "b", 1), (3, base.replace("lazy", "tired") + ".", "en", "a", 1),
        (4, None, "en", "a", None), (5, "", None, None, 0), (6, " \t\n", "en", None, 0), (7, "Short.", "fr", "c", 6),
        (8, "x " * 30_000, "en", "c", 1), (9, "Zeile eins ist hier.\nZeile eins ist hier.\n\nMenu | Home | Login", "de", "d", 1),
        (10, "prefix words before " + base + " and words behind it", "en", "a", 1), (2, base + ".", "en", "b", 1),
        (None, base + ".", "en", "a", 1), (11, "Ünïcödé ﬁn ‘quotes’ 数据 " * 5, "fr", "b", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def extra(df):
    """Clashing column names that an operator may use itself."""
    from pyspark.sql import functions as F
    for c in ("kept", "host", "n_words", "h", "fp", "th", "_TH", "target", "_copy", "_q", "_s", "_hit", "_rule", "root", "passes", "cut"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---- 1 SimHash -------------------------------------------------------------------

def brute_fingerprint(text):
    import xxhash
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps, bits=4):
    root = {f: f for f in fps}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(fps), 2):
        if bin(a ^ b).count("1") <= bits:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash_fingerprints_and_components(docs, empty):
    rows = simhash.fingerprints(docs)
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == len(doc_rows())
    want = {r[0]: brute_fingerprint(r[1]) for r in doc_rows()}
    comp = brute_components(set(want.values()))
    first = {}
    for i, f in want.items():
        if i is not None:
            first[comp[f]] = min(first.get(comp[f], i), i)
    for r in got:
        assert r["fp"] & (1 << 64) - 1 == want[r["doc_id"]]
        assert r["component_id"] == first[comp[want[r["doc_id"]]]]
    assert simhash.near_duplicates(simhash.fingerprints(empty)).count() == 0


@pytest.mark.parametrize(("hot", "max_bits"), [(2, 4), (64, 4), (2, 3), (64, 3), (2, 1)])
def test_simhash_links_connect_the_same_pairs(spark, hot, max_bits):
    rng = np.random.default_rng(7)
    fps = set()
    for c in rng.integers(0, 1 << 63, 12, np.uint64).tolist():
        for _ in range(40):
            f = c
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                f ^= 1 << b
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(sorted(fps))], "doc_id long, fp long")
    got = simhash.near_duplicates(df, max_bits, hot).collect()
    comp = brute_components(fps, max_bits)
    ids = {signed(f): i for i, f in enumerate(sorted(fps))}
    first = {}
    for f in fps:
        first[comp[f]] = min(first.get(comp[f], 1 << 60), ids[signed(f)])
    assert {r["doc_id"]: r["component_id"] for r in got} == {ids[signed(f)]: first[comp[f]] for f in fps}


def test_simhash_keep_one(docs, empty):
    kept = simhash.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert 1 in ids and 2 not in ids and None not in ids and 4 in ids and 5 not in ids and 7 in ids
    assert simhash.keep_one(empty).count() == 0


def test_segments_follow_the_pigeonhole():
    for n in (10, 10**5, 10**9):
        parts = simhash.segments(n, 4)
        assert sum(b for _, b, _ in parts) == 64 and sum(r + 1 for _, _, r in parts) >= 5


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 4, 5])
def test_segments_bound_probes_and_candidates(max_bits):
    for n in (1, 10**4, 10**6, 10**8, 10**9):
        parts = simhash.segments(n, max_bits)
        probes, candidates = simhash.lookup_cost(n, parts)
        assert sum(b for _, b, _ in parts) == 64 and sum(r + 1 for _, _, r in parts) == max_bits + 1
        if max_bits <= 4:
            assert probes < 1_000
            assert candidates < 1_000 or n < 10**9


@pytest.mark.parametrize("apply", [
    lambda d: simhash.keep_one(d), lambda d: mixing.apply_mix(d), lambda d: quality.clean_documents(d, with_text=False),
    lambda d: toxicity.score_documents(d, None), lambda d: url_filter.filter_urls(d, "text")])
def test_clashing_columns_are_carried(docs, apply):
    given = extra(docs)
    out = apply(given)
    carried = [c for c in given.columns if c.startswith("_") or c in ("root", "passes", "cut")]
    assert set(given.columns) <= set(out.columns) and out.count() > 0
    assert {tuple(r) for r in out.select(*carried).collect()} == {("clash",) * len(carried)}


# ---- 2 language ------------------------------------------------------------------

def test_language_on_held_out_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = language.identify(spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet"))
    url = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS truth")
    rows = got.join(url, "page_id").collect()
    assert sum(r["lang"] == r["truth"] for r in rows) >= 0.95 * len(rows)
    assert sum(r["text_lang"] == r["truth"] for r in rows) >= 0.95 * len(rows)


def test_language_edges(spark, docs, empty):
    schema = "page_id long, url string, html string, lang string, confidence string, host string"
    page = spark.createDataFrame([(1, None, None, "z", "z", "z"), (2, "http://a.b/", "", "z", "z", "z"),
                                  (2, "http://a.b/", "", "z", "z", "z"),
                                  (3, "x", '<html lang="DE-at"><p>Zeile eins ist hier.</p>' * 2000, "z", "z", "z")], schema)
    rows = language.identify(page, docs).collect()
    assert len(rows) == 4 and all(r["lang"] in ("de", "en", "fr") and 0 < r["confidence"] <= 1 for r in rows)
    assert {r["declared"] for r in rows if r["page_id"] == 3} == {"de"}
    assert language.identify(page.limit(0), docs).count() == 0
    assert {r["lang"] for r in language.identify(page, empty).collect()} == {None}


# ---- 3 repeats -------------------------------------------------------------------

def brute_repeats(rows, length=50):
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k:k + length], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k:k + length]] < i:
                gone[k:k + length] = True
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(len(gone) and gone[0])
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def random_texts():
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abcé \n"), rng.integers(30, 160))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [pool[k][rng.integers(0, 20):] for k in rng.integers(0, 12, rng.integers(1, 6))]
        rows.append((int(i // 1.05), "".join(parts)))
    return [*rows, (70, "z" * 400), (71, "z" * 120), (72, None), (73, ""), (None, pool[0] * 2), (74, "short")]


@pytest.mark.parametrize("length", [8, 21, 80, 120])
def test_repeats_of_other_lengths_equal_brute_force(spark, length):
    rows = random_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffix_repeats.remove_repeats(df, length).collect()), key=repr) == brute_repeats(rows, length)


@pytest.mark.parametrize("group", [20_000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_repeats, "GROUP", group)
    rows = random_texts()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pos string").repartition(4)
    got = sorted(map(tuple, suffix_repeats.remove_repeats(df).collect()), key=repr)
    assert got == brute_repeats(rows)
    assert suffix_repeats.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_repeats, "PIECE", 64)
    texts = [t.encode() for _, t in random_texts() if t]
    whole = {(t, o + i) for t, o, n, *_ in zip(*suffix_repeats.phrases(texts), strict=True) for i in range(n)}
    cut = set()
    for t, raw in enumerate(texts):
        for off, piece in suffix_repeats._pieces(raw, 50):
            for _, o, n, *_ in zip(*suffix_repeats.phrases([piece]), strict=True):
                cut |= {(t, off + o + i) for i in range(n)}
    assert whole == cut


def test_maximal_repeats_equal_brute_force():
    texts = [b"xxabcabcabyy", b"zabcabq", b"abcabq"]
    got = {(n, tuple(sorted(o))) for n, o in suffix_repeats.maximal_repeats(
        texts, np.zeros(3, np.int64), np.array([len(t) - 2 for t in texts]), 3)}
    want = set()
    subs = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 3, len(t) + 1)}
    for s in subs:
        occ = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - len(s) + 1) if t[i:i + len(s)] == s]
        left = {texts[k][i - 1] if i else (k, "start") for k, i in occ}
        right = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else (k, "end") for k, i in occ}
        starts = any(i == 0 for _, i in occ)
        if len(occ) > 1 and (len(left) > 1 or starts) and len(right) > 1:
            want.add((len(s), tuple(sorted(occ))))
    assert got == want


# ---- 4 quality -------------------------------------------------------------------

def brute_repeat_words(words, w=8):
    seen, mark = {}, [False] * len(words)
    for i in range(len(words) - w + 1):
        seen.setdefault(tuple(words[i:i + w]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                mark[i:i + w] = [True] * w
    return sum(mark)


def test_quality_counts_and_verdicts(docs, empty):
    got = quality.clean_documents(extra(docs)).collect()
    assert len(got) == len(doc_rows())
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_repeat_words"] == brute_repeat_words(words)
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])
    nine = next(r for r in got if r["doc_id"] == 9)
    assert nine["n_dup_lines"] == 1 and nine["n_symbols"] == 2 and nine["clean_text"].endswith("hier.\n")
    assert next(r for r in got if r["doc_id"] == 1)["kept"]
    assert quality.clean_documents(empty).count() == 0


# ---- 5 toxicity ------------------------------------------------------------------

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = toxicity.score_documents(docs.join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id"),
                                    model).select("truth", "toxic", "expected_severity").collect()
    toxic = [r for r in rows if r["truth"] == 1]
    clean = [r for r in rows if r["truth"] == 0]
    assert sum(r["toxic"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["toxic"] for r in clean) <= 0.02 * len(clean)
    assert all(np.diff(model.thetas) > 0)


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None and toxicity.train(empty, labels.limit(0)) is None
    rows = toxicity.score_documents(extra(docs), None).collect()
    assert len(rows) == len(doc_rows()) and not any(r["toxic"] for r in rows)
    model = toxicity.train(docs, spark.createDataFrame([(1, 0), (7, 1), (9, 0)], "doc_id long, toxic int"))
    assert toxicity.score_documents(docs, model).count() == len(doc_rows())
    assert toxicity.score_documents(empty, model).count() == 0


# ---- 6 decontamination -----------------------------------------------------------

def test_decontamination_finds_substituted_passages(spark, docs, empty):
    words = LOREM.split()
    changed = words.copy()
    changed[7] = "sleepy"
    bench = spark.createDataFrame([(100, " ".join(words)), (101, None), (102, ""), (103, "four word item only"),
                                   (104, "Zeile eins ist hier Zeile"), (None, "never seen passage of words here at all now")],
                                  "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(50, "Intro. " + " ".join(changed).upper() + "! Outro.", "en", "a", 1)], DOC))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(more, bench).collect()}
    assert {(1, 100), (2, 100), (3, 100), (10, 100), (50, 100), (None, 100), (9, 104)} == got
    kept = [r["doc_id"] for r in decontaminate.remove_leaks(more, bench).collect()]
    assert sorted(kept) == [4, 5, 6, 7, 8, 11]
    small = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(more, bench, block_seeds=20).collect()}
    assert small == got
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.remove_leaks(docs, bench.limit(0)).count() == docs.count()


def brute_stretch(same):
    """(equal words, -length) of the best stretch by trying all of them."""
    return max((sum(same[i:j]), i - j) for i in range(len(same)) for j in range(i + 1, len(same) + 1)
               if 5 * sum(same[i:j]) >= 4 * (j - i))


def test_decontamination_finds_every_substitution():
    for n in (15, 17, 20):
        item = [f"w{i}" for i in range(n)]
        block = decontaminate.Block([(1, " ".join(item))])
        for k in (1, 2, 3):
            for at in combinations(range(n), k):
                text = ["left", "side", *("x" if i in at else w for i, w in enumerate(item)), "right"]
                matched, length = brute_stretch([i not in at for i in range(n)])
                got = [(m, -size) for _, m, size, _ in block.overlaps(" ".join(text))]
                assert got == ([(matched, length)] if matched >= 12 else []), (n, at)


def test_decontamination_finds_changed_short_items():
    for n in range(5, 15):
        item = [f"w{i}" for i in range(n)]
        block = decontaminate.Block([(1, " ".join(item))])
        for k in range(4):
            for at in combinations(range(n), k):
                text = ["left", "side", *("x" if i in at else w for i, w in enumerate(item)), "right"]
                matched, length = brute_stretch([i not in at for i in range(n)])
                got = [(m, -size) for _, m, size, _ in block.overlaps(" ".join(text))]
                assert got == ([(matched, length)] if 5 * matched >= 4 * n else []), (n, at)
    assert not decontaminate.Block([(1, "four word item only")]).overlaps("a four word item only b")


def test_decontamination_of_items_under_five_words():
    block = decontaminate.Block([(1, "four word item only"), (2, "Yes."), (3, "!")])
    assert block.overlaps("First line\n- Four word item ONLY?\nyes and no\n yes \n") == [(1, 4, 4, 2), (2, 1, 1, 9)]
    assert not block.overlaps("First line four\nword item only") and not block.overlaps("") and not block.overlaps(None)


def test_decontamination_of_scripts_without_spaces():
    item = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。"
    block = decontaminate.Block([(1, item), (2, "東京")])
    n = len(decontaminate.words_of(item))
    assert n == len(item) - 3
    assert block.overlaps("「" + item) == [(1, n, n, 0)]
    assert block.overlaps("x " + item.replace("見", "健"))[0][:2] == (1, n - 1)
    assert not block.overlaps("東京は日本の首都である") and block.overlaps("首都\n東京") == [(2, 2, 2, 2)]
    assert not block.overlaps("まったく別の文章がここに長く書かれている")


def test_decontamination_reports_every_copy():
    item = [f"w{i}" for i in range(20)]
    block = decontaminate.Block([(1, " ".join(item))])
    text = " ".join([*item, "between", *item[:18], "x", "y", "z", *item])
    assert block.overlaps(text) == [(1, 20, 20, 0), (1, 18, 18, 21), (1, 20, 20, 42)]
    many = decontaminate.Block([(1, "a b " * 10)]).overlaps("a b " * 40)
    assert [s[3] for s in many] == sorted(s[3] for s in many) and sum(s[2] for s in many) <= 80
    assert all(x[3] + x[2] <= y[3] for x, y in zip(many, many[1:], strict=False)) and len(many) == 4


def test_best_stretch_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.5, 0.75, 0.9])
        matched, start, length = decontaminate.best_stretch(same)
        assert (matched, -length) == (brute_stretch(same.tolist()) if same.any() else (0, 0))
        assert int(same[start:start + length].sum()) == matched


def spoiling(masks, n):
    """Least substitutions in ``n`` words that spoil every seed."""
    last = {0: 0}
    for p in range(1, n + 1):
        new = {}
        for seen, c in last.items():
            for bit in (0, 1):
                w = (seen << 1 | bit) & (1 << 13) - 1
                if all(p < len(m) or w & int(m, 2) for m in masks):
                    new[w & (1 << 12) - 1] = min(c + bit, new.get(w & (1 << 12) - 1, n))
        last = new
    return min(last.values())


def test_seeds_survive_the_tolerated_substitutions():
    assert all(spoiling(decontaminate.MASKS, n) > n // 5 for n in [*range(13, 27), 30, 40])
    assert all(spoiling(decontaminate.SHORT_MASKS, n) > n // 5 for n in range(5, 15))


# ---- 7 mixing --------------------------------------------------------------------

def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    cap = {s: 3.0 * sizes[s] for s in names}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while rest > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in list(free):
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(free):
            if target[s] > cap[s]:
                rest += target[s] - cap[s]
                target[s] = cap[s]
                free.remove(s)
    return target


def test_mixing_reaches_its_targets(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] in [k * r["size"] for k in range(4)]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 0.02 * sizes[s] + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def test_mixing_edges(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(doc_rows()) and {r["source"] for r in rows} == {"a", "b", "c", "d", None}
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
    out = mixing.apply_mix(extra(docs))
    assert out.count() == sum(r["copies"] for r in rows) and out.columns == extra(docs).columns
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


# ---- 8 line dedup ----------------------------------------------------------------

def test_line_dedup_drops_site_boilerplate(spark):
    html = "<html><head><title>t</title></head><body><nav><li>Menu</li></nav><p>Text {0} here</p><p>Text {0} here</p></body>"
    rows = [(i, "http://a.org/x", html.format(i)) for i in range(6)] + [(9, "http://b.org/", html.format(9)), (10, None, None),
                                                                        (10, "http://a.org/x", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, drop string")
    lines = df.select("page_id", url_filter.host_of(df["url"]).alias("host"), pages.visible_lines(df["html"]).alias("lines"),
                      "drop", df["drop"].alias("_kept"), df["drop"].alias("host_pages"), df["drop"].alias("Text"), df["drop"].alias("n"), df["drop"].alias("_salt"))
    assert set(line_dedup.dedup_lines(lines).columns) == {"page_id", "host", "drop", "_kept", "n", "_salt", "host_pages", "n_lines", "n_dropped", "text"}
    assert {tuple(r) for r in line_dedup.dedup_lines(lines).select("drop", "_kept").collect()} == {("clash", "clash")}
    got = line_dedup.dedup_lines(lines).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["host"] == "a.org" and r["n_lines"]:
            assert r["n_dropped"] == 1 and r["text"] == f"Text {r['page_id']} here\nText {r['page_id']} here"
        elif r["host"] == "b.org":
            assert r["n_dropped"] == 0 and r["text"].startswith("Menu\n")
    assert line_dedup.dedup_lines(lines.limit(0)).count() == 0


def test_line_dedup_of_a_host_with_most_pages(spark):
    rows = [(i, "hot.org" if i % 10 else f"h{i % 7}.org", ["Menu", f"Text {i % 400}", "Menu", "Text 1"] if i % 3 else [f"only {i}"])
            for i in range(2000)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "page_id long, host string, lines array<string>").repartition(5))
    from collections import Counter
    pages_of = Counter(h for _, h, _ in rows)
    holding = Counter((h, x) for _, h, lines in rows for x in set(lines))
    want = {}
    for i, h, lines in rows:
        kept = [x for x in lines if not (holding[h, x] > 1 and pages_of[h] >= 5 and holding[h, x] > 0.2 * pages_of[h])]
        want[i] = (h, pages_of[h], len(lines), len(lines) - len(kept), "\n".join(kept))
    assert {r.page_id: (r.host, r.host_pages, r.n_lines, r.n_dropped, r.text) for r in got.collect()} == want


# ---- 9 token files ---------------------------------------------------------------

def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 0), (1000, 7), (3000, 100_000), (700, 3)):
        ends = np.cumsum(rng.integers(0, top + 1, n))
        ids, b = token_ids.unpack(token_ids.pack(np.arange(ends[-1]) % 60_000, ends, 2))
        assert (b.all() == ends).all() and [b.select(i) for i in range(n)] == ends.tolist()
        assert len(ids) == ends[-1]


def test_tokens_equal_whole_text_encoding(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    odd = [(10_000, "a<|endoftext|>b don't\x0bSTOP it é ́x \x1c y\x85z"), (10_001, "İI ΣΑΣ ﬀ ½"), (10_002, None), (10_003, "")]
    rows = [*map(tuple, real), *odd]
    got = token_ids.tokens_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).orderBy("doc_id").collect()
    at = 0
    for (i, t), r in zip(sorted(rows, key=lambda r: r[0]), got, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    folder = token_ids.new_path(spark, "tokens-test")
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_ids.write_tokens(df, path, folder, file_ids=2_000, partitions=2)
    assert manifest.count() == 2
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t in sorted(rows, key=lambda r: r[0])]
    read = token_ids.read_tokens(spark, folder, manifest, with_ids=True).orderBy("doc_id").collect()
    assert [r["ids"] for r in read] == want
    places = [0, 1, 17, len(rows) - 1, 17, -1, len(rows), None]
    some = token_ids.read_documents(spark, folder, manifest, spark.createDataFrame([(x,) for x in places], "n long")).collect()
    assert sorted((r["number"], r["ids"]) for r in some) == [(x, want[x]) for x in sorted({0, 1, 17, len(rows) - 1})]
    assert token_ids.qualified(spark, "file:/x/y") == token_ids.qualified(spark, "/x/y") == "file:///x/y"
    many = token_ids.tokens_of(extra(docs), path)
    assert many.count() == len(doc_rows()) and token_ids.tokens_of(empty, path).count() == 0



def test_parts_equal_whole_text_encoding_on_odd_characters():
    """Letters, marks, digits, apostrophes, controls, special tokens and other scripts in any order."""
    import random

    import public_tokenizers
    import pyarrow as pa
    enc = token_ids.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), cache_words=500)
    rng = random.Random(7)
    bits = [*"aAbZz'sStTrRvVmMlLdD..,,!?#&<>|()=0123 \n\t\r\x0b\x0c\x00\x1c\x7féÉßÿ÷×øØ \u0085\u0338\u0301İıſ 中Яя٣²ªº😀",
            "<|endoftext|>", "<|", "'re", "don't", "ΑΣ ", "é"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(3_000)] + [None, "", " "]
    for lo in range(0, len(texts), 250):
        part = texts[lo:lo + 250]
        ids, n = enc.encode(pa.array([None, *part], pa.string()).slice(1), 2)
        want = [e.ids + [2] for e in enc.tokenizer.encode_batch_fast([t or "" for t in part], add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    none, no_lengths = enc.encode(pa.array([], pa.string()), 2)
    assert len(none) == 0 and len(no_lengths) == 0


# ---- 10 urls ---------------------------------------------------------------------

def test_url_rules_and_terms(spark):
    rows = [(1, "http://EXAMPLE.org/es/x"), (2, "https://a.example.org/en/15"), (3, "http://b.com/fr/casino"), (4, "http://b.com/de/"),
            (5, "http://x.net/casino-night"), (6, "http://x.net/casinos"), (7, "http://x.net/free/win"), (8, "http://x.net/free-free"),
            (9, None), (10, "no-scheme porn"), (11, "http://org"), (12, "http://x.org/?q=porn"), (12, "http://x.org/?q=porn"), (13, "")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got == {
        1: ("example.org", "/es/x", "example.org/es/", "block"), 2: ("a.example.org", "/en/15", "example.org/en/1", "block"),
        3: ("b.com", "/fr/casino", "com/fr/", "allow"), 4: ("b.com", "/de/", "com/de/", "block"),
        5: ("x.net", "/casino-night", None, "block"), 6: ("x.net", "/casinos", None, "allow"),
        7: ("x.net", "/free/win", None, "block"), 8: ("x.net", "/free-free", None, "allow"), 9: ("", "", None, "allow"),
        10: ("", "", None, "block"), 11: ("org", "", None, "allow"), 12: ("x.org", "/", "org/", "allow"), 13: ("", "", None, "allow")}
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# ---- pipeline --------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    seen = docs
    for name, stage in P.STAGES[:-1]:
        out = P.staged(stage(spark, seen, sf), "test")
        assert out.columns == docs.columns
        if name != "mixing":
            assert 0 < out.count() <= seen.count()
        seen = out
    final = P.run(spark, sf)
    assert final.count() == seen.count() and set(final.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}
