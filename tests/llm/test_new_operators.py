"""Lexical search, personal data and whitening: brute force, hand-made cases, odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelsieve.llm import lexical, sanitise, whitening

# --- lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def searched(docs, items, top=10):
    """Every document against every item, as the contract words it."""
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counts = [c for c in counts if c[2]]
    n, total = len(counts), sum(c[2] for c in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in counts:
            m = 100 - 75 + (75 * size * n) // total
            score = 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(out, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAzZ09_-éÉß ̈\x00\x7f\x80\xa0　中\t\n.'"), max_size=40))
def test_terms(text):
    assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_search_against_brute_force(spark, documents, benchmark_items):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark_items.collect()]
    assert rows_of(lexical.search(documents, benchmark_items)) == searched(docs, items)


@pytest.mark.parametrize("blocks, groups, most_terms", [(7, 3, 1_000_000), (50, 256, 0)])
def test_search_in_small_blocks(spark, monkeypatch, blocks, groups, most_terms):
    """Bundles of many blocks and groups, with and without the broadcast of terms."""
    monkeypatch.setattr(lexical, "GROUP_ITEMS", groups)
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", most_terms)
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(6000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(5, "w1 " * 70_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(20)] + [(90, docs[7][1])]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(-(-400 // blocks))
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical.search(rows, asked)) == searched(docs, items)


def test_search_drops_only_what_cannot_win():
    scores = np.array([0, 5, 9, 9, 1, 7], np.int64)
    assert lexical._kept(scores, 2, 2).tolist() == [2, 3, 5]
    assert lexical._kept(scores, 0, 2).tolist() == [2, 3]
    assert lexical._kept(scores, 0, 9).tolist() == [1, 2, 3, 4, 5]


def test_search_of_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame(
        [(1, "seven SIX five", 3), (2, None, 3), (3, "", 3), (None, "seven SIX five", 3), (4, "...", 3), (5, "absent", 3)],
        "item_id long, text string, doc_id int",
    )
    found = lexical.search(odd, items).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = searched(docs, [(1, "seven SIX five"), (None, "seven SIX five")])
    assert sorted(map(tuple, found), key=repr) == want
    # Repeated ids have ranks of their own; a null id comes last among equals.
    assert [r["doc_id"] for r in sorted((r for r in found if r["item_id"] == 1), key=lambda r: r["rank"])] == [5, 5, 6, None]
    for docs_, items_ in ((nothing, items), (odd, items.limit(0)), (odd.where("text is null"), items)):
        none = lexical.search(docs_, items_)
        assert none.collect() == [] and dict(none.dtypes) == {
            "item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"
        }


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


PIECES = ["a@b.c", "x.y@mail-1.example.com", "@", ".", "..", "+", "-", " ", "(", ")", "1", "12", "255", "256", "0",
          "4111111111111111", "4111 1111-1111 1111", "+1 (555) 010-9999", "10.0.0.1", "é", "_", "%", "\n", "007",
          "5500005555555559", "a", "com", "１"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_patterns_as_worded(text):
    assert sanitise.base_spans(text) == plain_spans(text)


def test_patterns_on_documents(documents):
    for r in documents.collect():
        assert sanitise.base_spans(r["text"] or "") == plain_spans(r["text"] or "")


@pytest.mark.parametrize("run", ["a", "1", "1.", "1 ", "+1", "@", "a@", "a.", "1-", "+1 ("])
def test_long_runs_take_no_square_time(run):
    import time

    began = time.time()
    sanitise.base_spans(run * (200_000 // len(run)))
    assert time.time() - began < 5


def plain_terms(texts, generalise=sanitise.GENERALISE):
    """Shares of disclosed information, by counting distinct texts."""
    texts = sorted(set(texts))
    near, contexts, entities = {}, {}, {}
    for k, text in enumerate(texts):
        spans = plain_spans(text)
        for entity, words in sanitise._surroundings(text, spans):
            entities.setdefault(entity, (set(), set()))
            entities[entity][0].add(k)
            entities[entity][1].add(tuple(words))
            for w in set(words):
                near.setdefault((w, entity), set()).add(k)
                contexts.setdefault((w, entity), set()).add(tuple(words))
    holds = {}
    for k, text in enumerate(texts):
        for w in {w.lower() for w in re.findall(r"[^\W_]+", text)}:
            holds.setdefault(w, set()).add(k)
    out = {}
    for (w, e), both in near.items():
        p_entity = len(entities[e][0]) / len(texts)
        if len(contexts[w, e]) < 3 or p_entity == 1 or len(entities[e][1]) < 3:
            continue
        pmi = math.log2(len(texts) * len(both) / (len(holds[w]) * len(entities[e][0])))
        share = pmi / -math.log2(p_entity)
        if share >= generalise:
            out[w] = max(out.get(w, 0), share)
    return out


def corpus():
    rng = random.Random(2)
    words = [f"word{k}" for k in range(200)]

    def filler(n):
        return " ".join(rng.choices(words, k=n))

    texts = [filler(40) for _ in range(300)]
    # A nickname that is always by one address, a place that mostly is, and a common word.
    texts += [f"{filler(12)} Zorro write zorro.k@mail.example.com {filler(12)}" for _ in range(12)]
    texts += [f"{filler(9)} Quito call +1 (555) 010-9{k:03d} or +1 (555) 444-4444 {filler(9)}" for k in range(20)]
    texts += [f"Quito {filler(9)}"]
    # One passage in many copies tells nothing, near copies of its ends neither.
    texts += [f"Onlyhere {filler(0)}is one two three four five six a.b@copy.example.com six seven eight nine ten eleven twelve"] * 50
    return texts


def test_disclosing_terms(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    found = {r["term"]: r["share"] for r in sanitise.disclosing_terms(df).collect()}
    want = plain_terms(texts)
    assert found.keys() == want.keys() and all(abs(found[w] - want[w]) < 1e-9 for w in want)
    assert {"zorro", "quito"} <= found.keys() and "onlyhere" not in found
    rows = {r["doc_id"]: r for r in sanitise.sanitise(df).collect()}
    r = rows[300]
    assert r["n_email"] == 1 and r["n_term"] >= 1 and "Zorro" not in r["sanitised"] and "[EMAIL]" in r["sanitised"]
    assert "term:" in r["spans"] and r["base_sha256"] != hashlib.sha256(r["spans"].encode()).hexdigest()
    # Base spans stay, in place and order.
    for i, text in enumerate(texts):
        base = ",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(text))
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        kept = [s for s in rows[i]["spans"].split(",") if s and not s.startswith("term:")]
        assert ",".join(kept) == base
        starts = [int(s.split(":")[1]) for s in rows[i]["spans"].split(",") if s]
        assert starts == sorted(starts)


def test_rounds_of_terms(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = rows_of(sanitise.sanitise(df))
    monkeypatch.setattr(sanitise, "ROUND_TERMS", 1)
    assert rows_of(sanitise.sanitise(df)) == want


def test_personal_data_of_odd_rows(spark, odd, nothing):
    found = sanitise.sanitise(odd).collect()
    assert len(found) == 12 and {r["base_sha256"] for r in found} == {hashlib.sha256(b"").hexdigest()}
    assert {r["spans"] for r in found} == {""} and sum(r["doc_id"] is None for r in found) == 2
    assert sanitise.sanitise(nothing).collect() == []
    assert sanitise.sanitised("a@b.cd 4 Bob", [(0, 0, 6)], [(7, 8, 0.96), (9, 12, 1.0)]) == "[EMAIL] [NUMBER] "


# --- whitening


def exact(vectors):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    cov = np.array([[(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j]) / (n * n) for j in range(len(sums))]
                    for i in range(len(sums))])
    return x, n, sums, cov


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for rows, dims, most in ((1, 3, 5), (130, 5, 2000), (64, 2, 1 << 45), (5000, 4, 3)):
        values = rng.integers(-most, most, (rows, dims))
        sums, products = whitening.scatter(values)
        big = values.astype(object)
        assert sums.tolist() == big.sum(axis=0).tolist() and products.tolist() == (big.T @ big).tolist()
    huge = whitening.to_integers(np.array([[1e30, -3.5], [2.25, 1e300]]))
    assert huge.tolist() == [[int(1e30) * 1024 + 100000, -3584 + 100000], [2304 + 100000, int(1e300) * 1024 + 100000]]
    assert whitening.scatter(huge)[1].tolist() == (huge.T @ huge).tolist()


def test_whitening_against_numpy(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    x, n, sums, cov = exact([v for _, v in rows])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = {}
    for r in whitening.whiten(df.repartition(7)).collect():
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(found) == n
    signs = None
    for (i, _), row in zip(rows, x):
        mine = [found[i][k] for k in range(1, 9)]
        off = [n * a - s for a, s in zip(row, sums)]
        assert {r["deviation"] for r in mine} == {sum(d * d for d in off)} and {r["n"] for r in mine} == {n}
        want = (np.array(off) / n) @ vectors[:, :8] / np.sqrt(values[:8])
        got = np.array([r["whitened"] for r in mine])
        signs = np.sign(got / want) if signs is None else signs
        assert np.allclose(got, want * signs, rtol=1e-6, atol=1e-6)
        assert np.allclose([r["explained"] for r in mine], values[:8] / np.trace(cov), rtol=1e-9)
        assert all(r["identity_error"] <= 1e-9 for r in mine)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5], 1), (1, [1.0, 2.0, 0.5], 1), (None, [0.0, 1.0, 0.25], 1), (2, [3.0, -1.0, 0.0], 1),
            (3, None, 1), (4, [1.0, None, 1.0], 1), (5, [nan, 1.0, 1.0], 1), (6, [inf, 1.0, 1.0], 1), (7, [], 1),
            (8, [1.0, 2.0], 1), (9, [5e10, 5e10, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    found = whitening.whiten(df).collect()
    assert Counter(r["vec_id"] for r in found) == {1: 6, None: 3, 2: 3, 9: 3}
    x, n, sums, _ = exact([r[1] for r in rows[:4]] + [rows[10][1]])
    far = next(r for r in found if r["vec_id"] == 9)
    # Beyond 64 bits the number is there as text.
    assert far["deviation"] is None and int(far["deviation_digits"]) == sum((n * a - s) ** 2 for a, s in zip(x[4], sums))
    same = whitening.whiten(df.where("vec_id = 1")).collect()
    assert len(same) == 6 and {(r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(None, None, None)}
    assert {r["deviation"] for r in same} == {0}
    flat = whitening.whiten(df.where("vec_id in (1, 2) and size(embedding) = 3")).collect()
    # Two different points span one component.
    assert {r["component"] for r in flat if r["whitened"] is not None} == {1}
    for none in (df.limit(0), df.where("vec_id = 3"), df.where("vec_id = 7")):
        out = whitening.whiten(none)
        assert out.collect() == [] and out.columns == whitening.whiten(df).columns
