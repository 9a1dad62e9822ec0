import random

from barweave.llm import decontaminate as D
from awkward import SMALL, clashing, docs, empty  # noqa: F401


def shingled(text, width=5):
    import re

    w = re.sub(r"[^0-9a-z\u0080-\U0010ffff]+", " ", text.lower()).split()
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or ([tuple(w)] if w else []), w


def brute(docs, items, least=0.75):
    """Best weighted similarity of any item-sized window, for every pair that reaches it."""
    sets = {i: set(shingled(t)[0]) for i, t in items if t}
    holders = {}
    for s in sets.values():
        for x in s:
            holders[x] = holders.get(x, 0) + 1
    weight = lambda s: sum(0.5 + 0.5 / holders.get(x, 1) for x in s)
    out = {}
    for d, text in docs:
        sh, w = shingled(text or "")
        for i, t in items:
            n = len(shingled(t or "")[1])
            if not n or not w or (n < 5) != (len(w) < 5) or (n < 5 and n != len(w)):
                continue
            span = max(1, min(n, len(w)) - 4)
            for k in range(len(sh) - span + 1):
                a = set(sh[k : k + span])
                if a & sets[i] and (s := weight(a & sets[i]) / weight(a | sets[i])) >= least - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), round(s, 6))
    return out


def found(spark, docs, items):
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.similarity for r in got.collect()}


def test_planted_passages_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**5)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(8, 50)))) for k in range(40)]
    items += [(40, items[0][1] + " tail"), (41, "one two"), (42, None), (43, "...")]
    docs = []
    for k in range(120):
        before, after = [word() for _ in range(rng.randrange(0, 80))], [word() for _ in range(rng.randrange(0, 80))]
        w = rng.choice(items[:40])[1].split()
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            w[rng.randrange(len(w))] = word()
        docs.append((k, " ".join(before + (w if k % 3 else []) + after).replace(" w1", rng.choice((" W1", ",\n w1", " w1")))))
    docs += [(200, "One, two!"), (201, "one two three"), (202, None), (203, ""), (204, items[3][1]), (204, items[3][1])]
    want = brute(docs, items)
    got = found(spark, docs, items)
    assert set(got) <= set(want)
    assert set(want) <= set(got)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert (200, 41) in got and (201, 41) not in got
    monkeypatch.setattr(D, "GROUP_ITEMS", 7)  # several passes find the same
    assert found(spark, docs, items) == got


def test_given_tables(spark, docs, clashing, empty):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    hits = D.contaminated(given, bench)
    want = brute([(r.doc_id, r.text) for r in given.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert {(r.doc_id, r.item_id) for r in hits.collect()} == set(want) != set()
    clean = D.decontaminated(given, bench)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in given.collect()} - {d for d, _ in want}
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while")], "item_id long, text string")
    left = D.decontaminated(clashing, items)
    assert left.columns == clashing.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(["4", "5", "6", "7", "8", "8", "9", "10", "None"])
    assert D.contaminated(empty, items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0
    assert D.decontaminated(docs, items.limit(0)).count() == docs.count()


def test_hamming_blocks_lose_nothing():
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 30, np.uint64)
    items = D.Items(list(range(30)), np.full(30, 9), [], np.zeros(1, np.uint64), np.ones(1, np.float32), base)
    tables = items.blocks(20)
    for i, v in enumerate(base):
        for _ in range(60):
            flipped = int(v)
            for b in rng.choice(64, 20, replace=False):
                flipped ^= 1 << int(b)
            near = np.zeros(tables[0].shape[1], np.uint8)
            for b, t in enumerate(tables):
                near |= t[(flipped >> 16 * b) & 0xFFFF]
            assert np.unpackbits(near, bitorder="little")[i]


def holds(docs, items, plain):
    """Pairs by brute force: weights over distinct word sequences, and plain Jaccard on request."""
    distinct = {}
    for _, t in items:
        distinct.setdefault(tuple(shingled(t or "")[1]), set(shingled(t or "")[0]))
    held = [x for s in distinct.values() for x in s]
    holders = {x: held.count(x) for x in set(held)}
    weight = lambda s: sum(0.5 + 0.5 / holders.get(x, 1) for x in s)
    out = set()
    for d, text in docs:
        sh, w = shingled(text)
        for i, t in items:
            own, span = set(shingled(t)[0]), max(1, min(len(shingled(t)[1]), len(w)) - 4)
            for a in (set(sh[k : k + span]) for k in range(len(sh) - span + 1)):
                if weight(a & own) >= (0.75 - 1e-9) * weight(a | own) or plain and len(a & own) >= 0.75 * len(a | own):
                    out.add((d, i))
    return out


def templates(rng, n, words):
    """Items of which pairs share half their words, and copies of them with words replaced."""
    word = lambda: f"w{rng.randrange(10**5)}"
    items, docs = [], []
    for k in range(n):
        half = [word() for _ in range(words // 2)]
        items += [(2 * k + j, " ".join(half + [word() for _ in range(words - len(half))])) for j in (0, 1)]
    for k in range(6 * n):
        w = rng.choice(items)[1].split()
        for _ in range(rng.choice((0, 1, 1, 2))):
            w[rng.randrange(len(w))] = word()
        docs.append((k, " ".join([word() for _ in range(9)] + w + [word() for _ in range(9)])))
    rng.shuffle(items)
    return docs, [(k, t) for k, (_, t) in enumerate(items)]


def test_groups_do_not_change_results(spark, monkeypatch):
    docs, items = templates(random.Random(3), 20, 40)
    whole = found(spark, docs, items)
    monkeypatch.setattr(D, "GROUP_ITEMS", 7)
    assert found(spark, docs, items) == whole != {}


def test_every_pair_at_the_similarity_is_found(spark):
    """3,000 copies with inner words replaced; half of the items share half their words with a twin."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**5)}"
    items = [(k, " ".join(word() for _ in range(rng.choice((39, 40, 41))))) for k in range(20)]
    items += [(k + 20, " ".join(t.split()[:30] + [word() for _ in range(10)])) for k, t in items[:10]]
    docs = []
    for k in range(3000):
        w = rng.choice(items)[1].split()
        w[rng.randrange(5, len(w) - 5)] = word()
        docs.append((k, " ".join(w)))
    want = holds(docs, items, False)
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    chosen = {(r.doc_id, r.item_id): r.by_fingerprint for r in got.collect()}
    assert len(want) > 1000 and set(chosen) >= want
    # the block tables alone choose nearly all; the rest is completed
    assert sum(chosen[k] for k in want) >= 0.99 * len(want)


def test_emptied_tables_choose_nothing():
    """The choice is made by the block tables: without them, or with a radius of 0, a copy is only completed."""
    rng = random.Random(8)
    item = [f"w{rng.randrange(10**5)}" for _ in range(60)]
    copy = item[:20] + ["zzz"] + item[21:]
    hold = lambda w: D.shingles(D.words(next(iter(D.slices(D.pa.array([" ".join(w)]), fold=True))), separators=D.PUNCT), 5)[1]
    own, value = D.np.unique(hold(item)), hold(["a", "b", *copy, "c"])
    items = D.Items([[1]], D.np.array([60]), [own], own, D.np.ones(len(own)))
    at = D.np.flatnonzero(D.np.isin(value, own))
    search = lambda radius: D._search(value, 63, items, at, D.np.searchsorted(own, value[at]), 5, 0.75, radius)[0]
    assert search(23)[4] and search(23)[3] <= 23 and search(23)[1] == -2
    assert not search(0)[4] and search(0)[:2] == search(23)[:2]
    for table in items.blocks(23):
        table[:] = 0
    assert not search(23)[4]


def test_repeated_items_do_not_raise_the_bar(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**5)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate(range(39, 54))]
    docs = [(k, " ".join(w[: len(w) // 2] + ["zzz"] + w[len(w) // 2 + 1 :])) for k, w in ((k, t.split()) for k, t in items)]
    once = found(spark, docs, items)
    assert set(once) == {(k, k) for k in range(15)}
    again = found(spark, docs, items + [(k + 100, t) for k, t in items] + [(k + 200, t.upper()) for k, t in items])
    assert again == {(d, i + r): s for (d, i), s in once.items() for r in (0, 100, 200)}
    twins = items + [(k + 100, t + " tail") for k, t in items] + [(k + 200, t + " end") for k, t in items]
    got = found(spark, docs, twins)
    assert set(got) == holds(docs, twins, True) > holds(docs, twins, False) and min(got.values()) >= 0.75
    assert {(k, k) for k in range(15)} <= set(got)


def test_several_groups_are_separate_passes(spark, monkeypatch):
    docs, items = templates(random.Random(6), 10, 40)
    docs += [(900, None), (901, ""), (902, "clean text of some few words"), (902, "clean text of some few words"), (0, "clean text of another row")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_text_key", D.F.lit("x")), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, D.decontaminated(a, b).collect()))
    monkeypatch.setattr(D, "GROUP_ITEMS", 7)
    got = D.decontaminated(a, b)
    assert got.columns == a.columns and sorted(map(str, got.collect())) == want and 5 <= len(want) < len(docs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1
