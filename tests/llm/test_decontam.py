"""Operator 9: recall on planted edits, exact distances, edges."""

import random

from teachspark.llm import decontam
from teachspark.llm.decontam import CHUNK, FUZZY, PIECE, Index, Searcher, best_window, codes, contaminated, drop_contaminated, normal

WORDS = [a + b for a in "th er on an re he in ed nd ha".split() for b in "at en es of or nt ea ti to it".split()]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def edit(rng, text, k):
    t = list(text)
    for _ in range(k):
        at, how = rng.randrange(len(t)), rng.randrange(3)
        if how == 0:
            t[at] = rng.choice("abcdefgh ")
        elif how == 1:
            t.insert(at, rng.choice("abcdefgh "))
        else:
            del t[at]
    return "".join(t)


def distance(a, b):
    """Least edit distance of ``a`` to any part of ``b``, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_best_window_is_exact():
    rng = random.Random(1)
    for _ in range(40):
        item = prose(rng, rng.randint(1, 12))
        text = prose(rng, 6) + " " + edit(rng, item, rng.randint(0, 5)) + " " + prose(rng, 6)
        edits, a, b = best_window(item, text, len(item))
        assert edits == distance(item, text) == distance(item, text[a:b])


def test_recall_and_precision():
    rng = random.Random(2)
    items = [prose(rng, rng.randint(12, 45)) for _ in range(60)]
    search = Searcher(Index.build(list(range(60)), [normal(t) for t in items]), 0.2)
    for rate, least in ((0.0, 1.0), (0.05, 1.0), (0.1, 0.97)):
        texts = [prose(rng, 50) + " " + edit(rng, items[i], int(rate * len(items[i]))).upper() + "\n " + prose(rng, 50) for i in range(60)]
        found = search.search(texts)
        assert sum(any(m[0] == i for m in f) for i, f in enumerate(found)) >= least * 60
        assert sum(len(f) for f in found) <= 60
        for text, matches in zip(texts, found, strict=True):
            for item, a, b, edits in matches:
                assert distance(normal(items[item]), normal(text)[a:b]) == edits <= 0.2 * len(items[item])
    assert not any(search.search([prose(rng, 300) for _ in range(40)]))


def test_table_and_edges(spark, edge_docs, no_docs):
    rng = random.Random(3)
    items = [(1, prose(rng, 20)), (2, prose(rng, 30)), (3, None), (4, ""), (5, "tiny bit"), (6, "word after word goes on"), (None, prose(rng, 15))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'own' as doc_id")
    texts = [prose(rng, 40) + " " + items[0][1] + " " + prose(rng, 9) + " " + items[1][1], "a Tiny  bit more", "tiny bits", items[6][1], None, prose(rng, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(0, 1, 0), (0, 2, 0), (1, 5, 0), (3, None, 0)], key=str)
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in contaminated(docs, bench, block=2).collect()), key=str) == got
    assert [r.doc_id for r in drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [2, 4, 5]
    assert {(r.doc_id, r.item_id) for r in contaminated(edge_docs, bench).collect()} == {(4, 6)}
    assert contaminated(no_docs, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_texts_that_begin_with_a_cut_item():
    """Several texts in one batch, each an item without its first word or characters: all anchors lie behind the cut."""
    rng = random.Random(5)
    items = [prose(rng, n) for n in (10, 12, 20, 30, 45, 80)]
    search = Searcher(Index.build(list(range(6)), [normal(t) for t in items]), 0.2)
    for cut in (lambda t: t.split(" ", 1)[1], lambda t: t[2:], lambda t: t[8:]):
        texts = [prose(rng, 9), *map(cut, items), prose(rng, 30)]
        assert [[m[0] for m in f] for f in search.search(texts)] == [[], [0], [1], [2], [3], [4], [5], []]
        assert [[(m[0], m[1]) for m in f] for f in search.search(texts)][1:-1] == [[(i, 0)] for i in range(6)]


def test_items_across_the_border_of_a_piece():
    rng = random.Random(6)
    items = [prose(rng, n) for n in (8, 12, 40)]
    search = Searcher(Index.build([0, 1, 2], [normal(t) for t in items]), 0.2)
    filler = normal(prose(rng, CHUNK // 5 + 100))[: CHUNK - 1].strip()
    for number, item in enumerate(items):
        for before in (0, len(item) // 4, len(item) // 2, 3 * len(item) // 4, len(item) - 2):
            # The item begins ``before`` characters in front of the border, edited in its first word.
            text = f"{filler[: CHUNK - before - 1].ljust(CHUNK - before - 1, 'z')} zz{item[2:]} {prose(rng, 40)}"
            found = search.search([prose(rng, 5), text])
            assert [[m[0] for m in f] for f in found] == [[], [number]] and found[1][0][3] == 2
            assert abs(found[1][0][1] - (CHUNK - before)) <= 2
    # Only the part behind the border is whole enough to collide.
    item = normal(prose(rng, 30))
    search = Searcher(Index.build([0], [item]), 0.2)
    worn = "".join("q" if i < 100 and i % 4 == 0 else c for i, c in enumerate(item))
    text = f"{filler[: CHUNK - 71].ljust(CHUNK - 71, 'z')} {worn} {prose(rng, 40)}"
    ((_, start, stop, edits),) = search.search([text])[0]
    assert edits == distance(item, worn) == distance(item, normal(text)[start:stop])


def items_of(rng, n, low, high):
    """Different items of ``low`` to ``high`` characters in normal form."""
    out = set()
    for _ in range(100 * n):
        if len(out) < n and low <= len(t := normal(prose(rng, rng.randint(low // 5, high // 5 + 1)))) <= high:
            out.add(t)
    assert len(out) == n
    return sorted(out)


def test_short_items_are_found_whole():
    """From FUZZY to PIECE characters no item within its edits is missed: the same pairs as brute force finds."""
    rng = random.Random(8)
    items = items_of(rng, 30, FUZZY, 30) + items_of(rng, 30, 30, PIECE - 1)
    search = Searcher(Index.build(list(range(60)), items), 0.2)
    for rate in (0.1, 0.2, 0.25):
        texts = [normal(prose(rng, rng.randint(0, 12)) + " " + edit(rng, t, int(rate * len(t))) + " " + prose(rng, 12)) for t in items]
        want = []
        for text in texts:
            near = ((i, best_window(t, text, len(t))[0], int(0.2 * len(t))) for i, t in enumerate(items))
            want.append([(i, edits) for i, edits, limit in near if edits <= limit])
        assert [[(m[0], m[3]) for m in f] for f in search.search(texts)] == want
        # The same when places are held a few at a time.
        saved, decontam.SPOTS = decontam.SPOTS, 3
        try:
            assert [[(m[0], m[3]) for m in f] for f in search.search([" ".join(texts)])] == [[(m[0], m[3]) for m in f] for f in Searcher(search.index, 0.2).search([" ".join(texts)])]
            assert [[(m[0], m[3]) for m in f] for f in search.search(texts)] == want
        finally:
            decontam.SPOTS = saved


def test_whole_result_equals_brute_force(spark):
    rng = random.Random(12)
    items = [(i, t) for i, t in enumerate(items_of(rng, 10, 16, 40) + items_of(rng, 10, 64, 110) + items_of(rng, 10, 150, 260))]
    texts = [prose(rng, 25) + " " + edit(rng, t, len(t) // 10) + "\n" + prose(rng, 25) for _, t in items] + [prose(rng, 90) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for doc, text in enumerate(texts):
        for i, t in items:
            edits, _, _ = best_window(t, normal(text), len(t))
            if edits <= int(0.2 * len(t)):
                want.add((doc, i, edits, len(t)))
    got = contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.edits, r.item_chars) for r in got.collect()} == want and len(want) >= 30
    # Items that read alike are reported under each of their ids.
    twice = spark.createDataFrame([*items, (100, items[25][1].upper()), (None, items[25][1])], "item_id long, text string")
    found = {r.item_id for r in contaminated(docs.where("doc_id = 25"), twice).collect()}
    assert {25, 100, None} <= found


def test_items_with_one_stem():
    """Many items share their beginning: each is still found, and few collisions with the stem alone are left to verify."""
    rng = random.Random(13)
    stem = "which of the following statements about "
    items = [normal(stem + prose(rng, rng.randint(9, 30))) for _ in range(1500)]
    search = Searcher(Index.build(list(range(1500)), items), 0.2)
    stems = " ".join(prose(rng, 15) + " " + stem + prose(rng, 25) for _ in range(8))
    assert len(search.candidates(codes(normal(stems)))) <= 100
    texts = [stems + " " + edit(rng, items[i], len(items[i]) // 10) for i in (0, 700, 1499)]
    assert [{m[0] for m in f} >= {i} for f, i in zip(search.search(texts), (0, 700, 1499), strict=True)] == [True] * 3
