import random

from llm.conftest import ODD_TEXTS, with_clashes
from oracle import differing

from tramline.llm import decontamination as dc

ITEM = "the quick brown fox jumps over the lazy dog and then it sleeps for many long hours"


def test_query_matches_its_sql(spark, folder):
    assert differing(dc.op10_decontamination(spark, folder), dc.OP10_SQL, folder) == ([], [])


def found(spark, docs, items, **options):
    d = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    i = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in dc.contained_items(d, i, **options).collect())


def test_short_items_in_long_documents(spark):
    words = ITEM.split()
    near, far = " ".join([*words[:-1], "weeks"]), " ".join([*words[:5], "x", *words[6:]])
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = [(1, f"{long} {ITEM.upper()}! {long}"), (2, f"{long} {near} {long}"), (3, f"{far} {long}"), (4, f"{' '.join(words[:8])} {long} {' '.join(words[8:])}")]
    n = len(words) - 4
    assert found(spark, docs, [(7, ITEM)]) == [(1, 7, n, n), (2, 7, n, n - 1)]


def test_threshold_is_met_exactly(spark):
    item = " ".join(f"a{i}" for i in range(9))  # five shingles, of which four are 0.8
    docs = [(1, " ".join(f"a{i}" for i in range(8))), (2, " ".join(f"a{i}" for i in range(7)))]
    assert found(spark, docs, [(1, item)]) == [(1, 1, 5, 4)]


def brute(docs, items, threshold=0.8):
    def cut(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    return sorted((d, i, len(b), len(a & b)) for d, x in docs for i, y in items for a, b in [(cut(x), cut(y))] if b and len(a & b) >= threshold * len(b) - 1e-9)


def test_items_of_all_sizes_with_stock_phrases_are_those_of_brute_force(spark):
    rng = random.Random(5)
    stock = "all answers must be given in full sentences on the sheet"
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join([stock] * (i % 3) + [word() for _ in range(rng.choice([3, 5, 6, 9, 17, 40, 90, 200]))])) for i in range(60)]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.randrange(300))] + stock.split()
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                own[rng.randrange(len(own))] = "changed"
            words += own
        docs.append((d, " ".join(words)))
    want = brute(docs, items)
    assert found(spark, docs, items) == want and len(want) > 60
    full = spark.createDataFrame([(i, s, hash(s) >> 2) for i, t in items for s in {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}], "item long, s string, h long")
    kept = dc.sketches(full, 0.8)
    assert kept.groupBy("h").count().agg({"count": "max"}).first()[0] < 20  # of 40 items with the stock phrase
    assert {r.part for r in kept.collect()} >= {0, 2, 3, 5, 6, 7}


def test_edge_cases(spark):
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, ITEM), (50, ITEM), (50, ITEM)]
    items = [(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "too short"), (None, ITEM), (6, "a b c d e a b c d e")]
    n = len(ITEM.split()) - 4
    assert found(spark, docs, items) == [(50, 1, n, n), (50, 2, n, n)]
    assert found(spark, docs, []) == [] and found(spark, [], items) == []
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.decontaminate(d, i).count() == len(ODD_TEXTS) + 1


def test_a_large_index_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    assert found(spark, [(1, ITEM)], [(1, ITEM)])[0][:2] == (1, 1)
