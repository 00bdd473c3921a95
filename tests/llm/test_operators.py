"""Operators against brute force, public libraries, round trips and held-out accuracy."""

import hashlib
import html
import itertools
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from labelsieve.llm import (
    buckets,
    fingerprints,
    graph,
    html_text,
    language,
    leaks,
    licenses,
    near,
    pieces,
    quality,
    texts,
    tokens,
    toxicity,
    walks,
)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = "aAéÉ'sStrem ll\n\t!?.,½²1́İßſK\x1c　　你Σςİẞ<|endoftext|>▁\U0001f600"


@pytest.fixture(scope="module")
def rows(documents):
    return [(r["doc_id"], r["text"], r["lang"]) for r in documents.orderBy("doc_id").collect()]


def shingles(text, n=5):
    words = text.lower().split()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


# --- fingerprints


def test_fingerprints_beside_next(documents, rows):
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_beside_next(documents).collect()}
    plan = walks.Walks()
    for k, (i, text, _) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = found[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = fingerprints.text_prints(plan, [texts.codepoints(t) for t in (text, edited, following)])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.tobytes().decode(), b.tobytes().decode())
        assert r["near_edited"] == fingerprints.likeness(a, b)
        assert r["near_next"] == fingerprints.likeness(a, c)
    assert min(r["near_edited"] for r in found.values()) > 0.5


def test_walk_is_the_same_alone_and_in_a_block():
    walk = walks.Walks()
    rng = random.Random(1)
    lengths = [rng.choice((0, 1, 5, 900)) for _ in range(90)]
    given_ = [texts.codepoints("".join(rng.choice("abc de") for _ in range(n))) for n in lengths]
    at, end = walk.steps(given_)
    for t, a, e in zip(given_, at, end):
        step, mine = 0, []
        for c in t:
            mine.append(step)
            step += int(walk.stay[(int(c) % walks.CLASSES) * walks.PERIOD + step % walks.PERIOD])
        assert (mine, step) == (a.tolist(), e)


def test_near_copies_of_fingerprints(spark):
    rng = random.Random(8)
    plan = walks.Walks()
    rows = []
    for group in range(12):
        text = "".join(rng.choice("abcdefgh  ") for _ in range(rng.choice((30, 200, 1500, 4000))))
        for copy in range(4):
            cut = int(len(text) * (1 - 0.03 * copy))
            rows.append((10 * group + copy, text[:cut] + "".join(rng.choice("xyz") for _ in range(len(text) - cut))))
    rows += [(1000, rows[0][1]), (1001, None), (None, rows[0][1])]
    prints = [
        (i, None if t is None else plan_print.tobytes().decode())
        for (i, t), plan_print in zip(rows, fingerprints.text_prints(plan, [texts.codepoints(t or "") for _, t in rows]))
    ]
    found = fingerprints.near_copies(spark.createDataFrame(prints, "doc_id long, fingerprint string")).collect()
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in found}
    assert len(found) == len(rows) and got[1001] == (1001, 0)
    assert got[1000] == got[None] == got[0] and got[0][0] == 0
    real = {i: np.frombuffer(p.encode(), np.uint8) for i, p in prints if p is not None and i is not None}
    for group in range(1, 12):
        for copy in range(4):
            mine = 10 * group + copy
            links = sum(j != mine and fingerprints.likeness(real[mine], p) >= 0.8 for j, p in real.items())
            assert got[mine] == (10 * group, links)


# --- near join


def test_near_join(documents, rows):
    found = {r["doc_id"]: (r["class_id"], r["links"]) for r in near.join_documents(documents).collect()}
    sets = {i: shingles(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    assert found == {i: (root(i), links[i]) for i in sets}


def test_alike_pairs_are_exact():
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)]
    many = []
    for _ in range(120):
        words = list(base) if rng.random() < 0.8 else [rng.choice("xyz") for _ in range(30)]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(500)}"
        many.append(" ".join(words))
    a, b = near.alike()(many)
    sets = [shingles(t) for t in many]
    pairs = itertools.combinations(range(len(many)), 2)
    want = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_large_buckets_are_cut_into_blocks(spark):
    # All rows share one bucket of band 0; pairs of neighbouring numbers are alike.
    n = 60
    df = spark.range(n).selectExpr("id", "1L AS weight", "array(7L, id) AS keys")

    def alike(payload):
        a, b = np.triu_indices(len(payload), 1)
        values = np.array(payload)
        close = np.abs(values[a] - values[b]) <= 1
        return a[close], b[close]

    out = buckets.bucket_links(df, lambda ids: ids.selectExpr("id", "id AS payload"), alike, block=16)
    links = Counter()
    edges = out.collect()
    for r in edges:
        links[r["id"]] += r["links"]
    assert links == {i: (1 if i in (0, n - 1) else 2) for i in range(n)}
    roots = {r["node"]: r["root"] for r in graph.components(out.selectExpr("id AS a", "other AS b")).collect()}
    assert set(roots.values()) == {0} and len(roots) == n


def test_bands_reach_the_recall():
    assert near.bands_for(0.8, 0.995, 4) == 11
    assert 1 - (1 - 0.8**4) ** near.bands_for(0.8, 0.995, 4) >= 0.995
    with pytest.raises(ValueError):
        near.bands_for(0.0, 0.9, 4)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {i: root(i) for i in parent} and len(found) == len(parent)


# --- benchmark leaks


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.text("abc", max_size=14))
def test_nearest(item, text):
    rows_ = [[0] * (len(text) + 1)]
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(rows_[-1][j - 1] + (c != d), rows_[-1][j] + 1, row[-1] + 1))
        rows_.append(row)
    best = min(rows_[-1])
    assert leaks.nearest(item, text) == (best, rows_[-1].index(best))


def test_leaks(documents, benchmark_items, rows):
    items = [(r["item_id"], r["text"]) for r in benchmark_items.collect()]
    found = {(r["doc_id"], r["item_id"]): r for r in leaks.find_leaks(documents, benchmark_items).collect()}
    exact = {(i, k) for i, t, _ in rows for k, item in items if item in t}
    assert exact <= set(found)
    text = {i: t for i, t, _ in rows}
    for (i, k), r in found.items():
        inside = re.sub(r"\s+", " ", text[i][r["begin"] : r["end"]].lower())
        item = re.sub(r"\s+", " ", dict(items)[k].lower())
        assert leaks.nearest(item, inside)[0] == r["distance"] <= 0.2 * len(item)
        if (i, k) in exact:
            assert r["distance"] == 0


def test_leak_recall(benchmark_items, rows):
    rng = random.Random(9)
    items = [(r["item_id"], r["text"]) for r in benchmark_items.collect()]
    index = leaks.index(items)
    caught = 0
    for k, (_, item) in enumerate(items):
        edited = "".join("" if (x := rng.random()) < 0.02 else c + "x" * (x > 0.97) for c in item)
        around = rng.choice(rows)[1]
        caught += any(hit[0] == k for hit in leaks.search(index, [f"{around} {edited} {around}"])[0])
    assert caught >= 0.95 * len(items)


def occurs(item, text, least=0.8):
    """Whether a part of the text is near enough, by the edit distance of every part."""
    return leaks.nearest(item, text)[0] <= int((1 - least) * len(item) + 1e-9)


def test_leaks_of_short_items(rows):
    short = ["Who wrote Romeo and Juliet?", "What is 12 times 12?", "yes", "a b"]
    rng = random.Random(3)
    items = short + ["".join(rng.choice("abcdefgh  ") for _ in range(n)).strip() + "?" for n in range(24, 44)]
    items = [" ".join(i.split()) for i in items]
    index = leaks.index(list(enumerate(items)))
    for k, item in enumerate(items):
        for _, around, _ in rows[:20]:
            text = f"{around} {item} {around}"
            hits = {h[0]: h for h in leaks.search(index, [text], exhaustive=True)[0]}
            assert hits[k][1] == 0 and text[hits[k][2] : hits[k][3]].lower().split() == item.lower().split()
    # Short ones between ends of words; longer ones also in part.
    assert leaks.search(index, ["eyes, yesterday", "(Yes)", "a  B", "a bc"]) == [[], [(2, 0, 1, 4)], [(3, 0, 0, 4)], []]
    assert leaks.search(index, ["who rote romeo and juliet", "who wrote hamlet and macbeth?"]) == [[(0, 2, 0, 25)], []]


def test_leaks_without_spaces():
    rng = random.Random(4)
    signs = [chr(0x4E00 + k) for k in range(400)] + [chr(0x0E01 + k) for k in range(40)] + list("のはをにで")

    def run(n):
        return "".join(rng.choice(signs) for _ in range(n))

    items = [run(n) for n in (6, 12, 23, 24, 40, 90, 300)] + ["one two", "incomprehensibilities antidisestablishmentarianism"]
    index = leaks.index(list(enumerate(items)))
    for k, item in enumerate(items):
        for before, after in ((run(200), run(200)), (run(50) + " ", run(50)), ("word other ", " and the")):
            if k >= 7:
                before, after = before + " ", " " + after
            text = before + item + after
            assert (k, 0, len(before), len(before) + len(item)) in leaks.search(index, [text], exhaustive=True)[0]
            if len(item) >= 5:
                for _ in range(5):
                    edited = list(item)
                    for at in rng.sample(range(len(item)), len(item) // 5):
                        edited[at] = rng.choice(["", "x"])
                    assert k in {h[0] for h in leaks.search(index, [before + "".join(edited) + after], exhaustive=True)[0]}


def edits(rng, text, share):
    """The text with a share of its characters dropped, replaced or followed by another."""
    chars = list(text)
    for at in rng.sample(range(len(chars)), int(share * len(chars))):
        chars[at] = rng.choice(["", rng.choice("aeinrst "), chars[at] + rng.choice("aeinrst ")])
    return "".join(chars)


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_leak_recall_by_brute_force(benchmark_items, rows, share):
    rng = random.Random(11)
    long = [" ".join(r["text"].lower().split()) for r in benchmark_items.collect()]
    items = long + [t[:n].strip() for t, n in zip(long, itertools.cycle(range(25, 80, 3)))]
    index = leaks.index(list(enumerate(items)))
    near = 0
    for k, item in enumerate(items):
        around = " ".join(rng.choice(rows)[1][:300].lower().split())
        text = " ".join(f"{around} {edits(rng, item, share)} {around}".split())
        found = {h[0]: h[1] for h in leaks.search(index, [text], exhaustive=True)[0]}
        for other in {k, *range(k % 20, len(items), 20)}:
            assert (other in found) == occurs(items[other], text)
        near += k in found
        assert k not in found or found[k] == leaks.nearest(item, text)[0]
    assert near >= 0.95 * len(items)


LENGTHS = [(5, 8), (8, 12), (12, 20), (20, 32), (32, 56), (56, 80), (80, 120), (120, 160), (160, 400)]


@pytest.mark.parametrize("least, most", LENGTHS)
@pytest.mark.parametrize("share", [0.0, 0.05, 0.1, 0.15, 0.2])
def test_walks_against_the_exact_way(benchmark_items, rows, least, most, share):
    rng = random.Random(f"{least} {share}")
    items = set()
    for r in benchmark_items.collect():
        words = r["text"].lower().split()
        for k in range(0, len(words) - 1, 4):
            text, more = words[k], iter(words[k + 1 :])
            while len(text) < least and (word := next(more, None)):
                text += " " + word
            if least <= len(text) < most:
                items.add(text)
    items = rng.sample(sorted(items), min(60, len(items)))
    index = leaks.index(list(enumerate(items)))
    there = met = 0
    for k, item in enumerate(items):
        around = " ".join(rng.choice(rows)[1][:200].lower().split())
        text = " ".join(f"{around} {edits(rng, item, share)} {around}".split())
        exact = {h[0]: h for h in leaks.search(index, [text], exhaustive=True)[0]}
        found = {h[0]: h for h in leaks.search(index, [text])[0]}
        # The walks find nothing that does not occur, and no farther place where they find one.
        assert found.items() <= exact.items() or all(found[i][1] >= exact[i][1] for i in found)
        there += k in exact
        met += k in exact and k in found
    assert there >= 0.9 * len(items) and met >= leaks.RECALL * there
    if not share:
        assert met == len(items)


def test_one_rule_of_nearness_for_every_length():
    items = ["the capital of France", "the capital of France is", "Paris"]
    index = leaks.index(list(enumerate(items)))
    for text in ("so the capitol of France it was", "The Capital of Frankce", "it is the capital of Franc"):
        assert 0 in {h[0] for h in leaks.search(index, [text])[0]}
    assert {h[0] for h in leaks.search(index, ["the capitol of france is"])[0]} == {0, 1}
    assert [h[0] for h in leaks.search(index, ["In Parris, as"])[0]] == [2]
    # Whole words only: five letters inside another word say nothing.
    assert leaks.search(index, ["a comparison", "disparisher"]) == [[], []]


def test_copies_of_an_item_are_searched_once(spark):
    items = spark.createDataFrame([(i, "one two three four five six seven eight") for i in range(500)], "item_id long, text string")
    (part,) = leaks._rounds(items, "text", 0.8)
    assert len(part.texts) == 1
    docs = spark.createDataFrame([(1, "so one two three four five six seven eight it is")], "doc_id long, text string")
    found = leaks.find_leaks(docs, items).collect()
    assert sorted(r["item_id"] for r in found) == list(range(500)) and {r["distance"] for r in found} == {0}


# --- licenses


def test_licenses(spark, documents, rows):
    def words(text):
        return [w for w in re.split(r"[\W_]+", text.lower()) if w]

    def cut(words_):
        return {tuple(words_[k : k + 5]) for k in range(len(words_) - 4)}

    notices = [(name, cut(words(n))) for name, all_ in licenses.NOTICES.items() for n in all_]
    want = defaultdict(float)
    for i, t, _ in rows:
        mine = cut(words(t))
        for name, notice in notices:
            share = len(mine & notice) / len(notice)
            siblings = [n for other, n in notices if other != name and len(n & notice) >= 0.5 * len(notice)]
            if share >= 0.8 and all(len(mine & (notice - n)) >= 0.5 * len(notice - n) for n in siblings):
                want[i, name] = max(want[i, name], share)
    for i, name in list(want):
        if (i, licenses.WITHIN.get(name)) in want:
            del want[i, name]
    found = licenses.scan(documents, licenses.templates(spark)).collect()
    assert {(r["doc_id"], r["license"]): r["containment"] for r in found} == want


SIBLINGS = {
    "GPL-2.0": "redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "modify it under the terms of the GNU Affero General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
    "Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. keep the notice 2. repeat the notice",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 3. Neither the name of the copyright holder nor the names of its "
    "contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
}


def test_sibling_licenses_get_their_own_names(spark):
    docs = spark.createDataFrame([(k, f"some words before {t} and some after") for k, t in enumerate(SIBLINGS.values())],
                                 "doc_id long, text string")
    found = licenses.scan(docs, licenses.templates(spark)).collect()
    names = list(SIBLINGS)
    assert sorted((names[r["doc_id"]], r["license"]) for r in found) == sorted((n, n) for n in names)


def test_license_scan_is_native(spark, documents):
    plan = licenses.scan(documents, licenses.templates(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_edited_long_notice(spark):
    notice = licenses.NOTICES["MIT"][2]
    words = notice.split()
    words[20] = "changed"
    text = "before it " * 50 + " ".join(words) + " after it" * 50
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), licenses.templates(spark))
    assert [r["license"] for r in found.collect()] == ["MIT"]


def test_notice_at_the_end(spark):
    notice = licenses.NOTICES["Apache-2.0"][0]
    texts_ = [f"{'word ' * (k % 2)}first{k} second{k} third{k} fourth{k} {notice}" for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    found = licenses.scan(docs, licenses.templates(spark)).collect()
    assert {r["doc_id"] for r in found if r["license"] == "Apache-2.0" and r["containment"] == 1.0} == set(range(400))


# --- quality


def test_quality(documents, labels, rows):
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    found = {r["doc_id"]: r for r in quality.resample(documents, labels).collect()}

    def grams(text):
        one = [int(h) for h in texts.word_hashes(text.lower().split())]
        first, second = (int(s) for s in texts.salts(2, 21))
        wrap = (1 << 64) - 1
        ints = [h ^ first for h in one]
        pairs = [(a * first + b * second) & wrap for a, b in zip(one, one[1:])]
        return [int(g) % quality.BUCKETS for g in texts.mix(np.array(ints + pairs, np.uint64))]

    raw, target = Counter(), Counter()
    for i, t, _ in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    for i, t, _ in rows:
        weight = sum(
            math.log((target[g] + 1) / (n_target + quality.BUCKETS)) - math.log((raw[g] + 1) / (n_raw + quality.BUCKETS))
            for g in grams(t)
        )
        assert found[i]["log_weight"] == pytest.approx(weight, abs=1e-6)
    keys = sorted((r["key"] for r in found.values()), reverse=True)
    least = keys[math.ceil(0.5 * len(keys)) - 1]
    assert {i for i, r in found.items() if r["selected"]} == {i for i, r in found.items() if r["key"] >= least}


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_kth_largest(spark, bins):
    rng = random.Random(bins)
    values = [rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 0.5, -3.0]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double").cache()
    ordered = sorted(values, reverse=True)
    for k in (1, 37, 200, 400):
        assert quality.kth_largest(df, "v", k, bins) == ordered[k - 1]


# --- toxicity and language


def test_toxicity_on_held_out_rows(spark, sf_dir):
    # The smallest tables have too few toxic rows to learn the words of four languages.
    folder = f"{os.path.dirname(sf_dir)}/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit_on(documents, labels)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    scored = [r for r in toxicity.score_documents(documents, model).collect() if r["held_out"] and r["doc_id"] in known]
    right = sum(r["predicted"] == known[r["doc_id"]] for r in scored)
    assert right >= 0.9 * len(scored) and len(scored) > 50


def test_toxicity_learns_sentences_and_beginnings():
    clean = [f"The garden number {k} is green. You are a kind{'xyz'[k % 3]} person. All is well." for k in range(60)]
    toxic = [f"The garden number {k} is green. You are a blorgo{'xyz'[k % 3]} person. All is well." for k in range(60)]
    model = toxicity.fit([(t, 0.0) for t in clean] + [(t, 1.0) for t in toxic])
    scorer = toxicity.Scorer(model)
    assert all(scorer.text(t) < 0.5 for t in clean) and all(scorer.text(t) >= 0.5 for t in toxic)
    text = "Fine day. What a blorgoq thing to say! Good night."
    spans = scorer.spans(text)
    assert [text[a:b].strip() for a, b, _ in spans] == ["What a blorgoq thing to say"]
    assert scorer.text("") == scorer.text("nothing known") == scorer.empty < 0.01


def test_language_on_held_out_rows(documents, rows):
    model = language.fit_on(documents)
    known = {i: la for i, _, la in rows}
    found = [r for r in language.predict_documents(documents, model).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in found) >= 0.95 * len(found)


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", min_size=1, max_size=30), st.text("abc ", max_size=40))
def test_phrases_are_longest_matches(training, text):
    model = language.fit({"x": [training]})
    if not len(language.symbols(training)):
        return
    known = bytes(np.append(language.symbols(training), np.uint8(language._GAP)))
    symbols = bytes(language.symbols(text))
    count, at = 0, 0
    while at < len(symbols):
        n = 1
        while at + n < len(symbols) and symbols[at : at + n + 1] in known and symbols[at : at + 1] in known:
            n += 1
        at += n
        count += 1
    assert language.phrases(model, [language.symbols(text)])[0, 0] == count


# --- tokens and pieces


def test_tokens(documents, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want = [len(e) for e in tokenizer.encode_batch([t for _, t, _ in rows], add_special_tokens=False)]
    found = {r["doc_id"]: r for r in tokens.count_tokens(documents, WORDS).collect()}
    assert [found[i]["n_tokens"] for i, _, _ in rows] == want
    assert [found[i]["n_bytes"] for i, _, _ in rows] == [len(t.encode()) for _, t, _ in rows]


@settings(max_examples=300, deadline=None)
@given(st.text(ODD, max_size=14))
def test_odd_tokens(text):
    global _LENGTHS, _TOKENIZER
    if "_LENGTHS" not in globals():
        from tokenizers import Tokenizer

        _LENGTHS, _TOKENIZER = tokens.Lengths(WORDS), Tokenizer.from_file(WORDS)
    assert _LENGTHS.count([text, text + "<|endoftext|>"]) == [
        len(_TOKENIZER.encode(t, add_special_tokens=False)) for t in (text, text + "<|endoftext|>")
    ]


def _models():
    from sentencepiece import sentencepiece_model_pb2

    with open(MODEL, "rb") as file:
        merges = file.read()
    proto = sentencepiece_model_pb2.ModelProto.FromString(merges)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)  # sums that the library's floats hold exactly
    unigram = proto.SerializeToString()
    proto.trainer_spec.byte_fallback = False
    for p in proto.pieces:
        if p.type == 6:
            p.type, p.score = 1, -40_000.0
    return {"merges": merges, "unigram": unigram, "unknown": proto.SerializeToString()}


@pytest.mark.parametrize("kind", ["merges", "unigram", "unknown"])
def test_pieces_are_the_library_s(kind, rows):
    import sentencepiece

    model = _models()[kind]
    mine, library = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(4)
    some = ["".join(rng.choice(ODD + "the ing  ") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    some += [" " * k + "x" + " " * k for k in range(40)] + [t for _, t, _ in rows]
    got = [mine.encode(t).tolist() for t in some]
    assert got == library.encode(some, num_threads=1)
    assert [mine.decode(g) for g in got] == library.decode(got)
    if kind != "unknown":
        assert all(mine.decode(g) == t for g, t in zip(got, some) if "▁" not in t)


# --- pages


def _article(source):
    """The article of the test pages, whose markup is known."""
    inside = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", source, re.DOTALL)
    text = re.sub(r"<[^>]*\Z", "", inside[1]).replace("<br>", " ") if inside else ""
    parts = (html.unescape(re.sub(r"<[^>]*>", "", p)) for p in re.split(r"</?(?:p|h1|article)>", text))
    return "\n".join(p for p in (re.sub(r"\s+", " ", p).strip() for p in parts) if p)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract_pages(pages).collect():
        assert r["text"] == _article(source[r["page_id"]]) and r["n_chars"] == len(r["text"])


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-banner">We use cookies</div>
<div id="main"><div class="post"><h2>Title &amp; more</h2><div class="text"><p>Para one  with
<a href="#">a link</a> and text that goes on for a while.</p><p>Para two is <i>also</i> here, and not short.</p>
<ul><li>item one<li>item two</ul></div></div><div class="sidebar"><p>Side text that is not the article</p></div>
<div id="comments"><p>I am a reader comment of some length, and loud.</p></div></div>
<form><label>Name</label><input></form><div hidden>unseen text of a page</div><footer>foot</footer></body></html>"""


def test_page_parts():
    assert html_text.main_text(PAGE) == (
        "Title & more\nPara one with a link and text that goes on for a while.\n"
        "Para two is also here, and not short.\nitem one\nitem two"
    )


@settings(max_examples=300, deadline=None)
@given(st.text("<>/!-=\"' apdivscrt&;", max_size=60))
def test_any_markup_has_a_text(source):
    text = html_text.main_text(source)
    assert "\n\n" not in text and text == text.strip()


# --- pipeline


def test_pipeline(spark, sf_dir, documents, labels, benchmark_items, rows):
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = documents
    model = toxicity.fit_on(docs, labels)
    toxic = {r["doc_id"] for r in toxicity.score_documents(docs, model).collect() if r["predicted"]}
    left = [(i, t) for i, t, _ in rows if i not in toxic and any(c.isalpha() for c in t)]
    items = [r["text"] for r in benchmark_items.collect()]
    sets = {i: shingles(t) for i, t in left}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        if len(a & b) >= 0.8 * len(a | b) - 1e-9:
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    want = {i for i, t in left if root(i) == i and not any(item in t for item in items)}
    # Beyond this brute force, benchmark items may also occur nearly.
    assert kept <= want and len(want - kept) <= 0.02 * len(rows)
