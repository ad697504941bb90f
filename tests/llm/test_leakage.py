import random

import numpy as np

from veritide.llm import leakage as L


def brute(doc: str, item: str) -> bool:
    """The definition by looking at every pair of places."""
    tok = L.tokenizer()
    d, i = tok(doc), tok(item)
    wide = sum(len(t) == 1 and ord(t) > 0x2E80 for t in i) * 2 > len(i)
    least = 20 if wide else 12
    for a in range(len(d)):
        for b in range(len(i)):
            if d[a] != i[b]:
                continue
            last, n = -6, 0
            while a + n < len(d) and b + n < len(i):
                if d[a + n] != i[b + n]:
                    if n - last < 6:
                        break
                    last = n
                elif n + 1 >= least:
                    return True
                n += 1
    return False


def run(spark, docs, items, **kw):
    return sorted(tuple(r) for r in L.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **kw).select("doc_id", "item_id").collect())


def corpus(seed):
    rng = random.Random(seed)
    words = "ab cd ef gh ij kl mn op".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, sentence(rng.randint(8, 30))) for k in range(12)]
    docs = []
    for k in range(80):
        t = rng.choice(items)[1].split()
        a = rng.randint(0, len(t))
        piece = t[a : a + rng.randint(3, 30)]
        for _ in range(rng.randint(0, 3)):
            if piece:
                piece[rng.randrange(len(piece))] = "zz"
        docs.append((k, f"{sentence(rng.randint(0, 9))} {' '.join(piece)} {sentence(rng.randint(0, 9))}"))
    return docs, items


def loose(doc: str, item: str) -> bool:
    """The same with words put in or left out too, tried at every place: no tile may go beyond this."""
    tok = L.tokenizer()
    d, i = tok(doc), tok(item)

    def walk(a, b, run, start, seen):
        if (a, b, run) in seen:
            return False
        seen.add((a, b, run))
        if run and min(a - start[0], b - start[1]) >= 12:
            return True
        if a < len(d) and b < len(i) and d[a] == i[b] and walk(a + 1, b + 1, min(run + 1, 9), start, seen):
            return True
        return (run >= 5 or run and a - start[0] == run) and any(walk(a + x, b + y, 0, start, seen) for x, y in ((1, 1), (1, 0), (0, 1)) if a + x <= len(d) and b + y <= len(i))

    return any(walk(a, b, 0, (a, b), set()) for a in range(len(d)) for b in range(len(i)) if d[a] == i[b])


def test_between_two_brute_forces(spark):
    """Everything with exchanged words is found; nothing is found that edits of one word cannot explain."""
    for seed in range(3):
        docs, items = corpus(seed)
        got = run(spark, docs, items)
        want = {(d, i) for d, t in docs for i, x in items if brute(t, x)}
        texts, stock = dict(docs), dict(items)
        assert want and want <= set(got) and all(loose(texts[d], stock[i]) for d, i in set(got) - want)


def test_many_items_by_a_join_give_the_same(spark):
    docs, items = corpus(9)
    docs += [(900, None), (901, ""), (902, docs[0][1]), (902, docs[0][1])]
    assert run(spark, docs, items, block_tokens=20) == run(spark, docs, items)
    assert run(spark, docs, items, block_tokens=20, threshold=0.4) == run(spark, docs, items, threshold=0.4)


ITEM = "The bank file was reopened to recover the table plan in favour of the paper ballot"
JA = "出展者の一覧は理屈に逆らって青い蝋燭の作り方を春が来るまで磨き上げました"


def test_what_does_not_matter_and_what_does(spark):
    docs = [(1, ITEM.upper().replace(" ", "\n")), (2, "“The bank-file”? no. " + ITEM.replace("reopened", "re­opened").replace(" ", " ​ ")), (3, " ".join(ITEM.split()[:11])), (4, " ".join(ITEM.split()[2:14])),
            (5, ITEM.replace("recover", "hide")), (6, ITEM.replace("recover the", "hide a")), (7, JA[5:25]), (8, JA[5:24]), (9, None), (10, ""), (11, " "), (12, ITEM + " " + ITEM), (13, "x " * 20000 + ITEM)]
    got = run(spark, docs, [(1, ITEM), (2, JA), (3, None), (4, ""), (5, "too short to leak")])
    assert got == [(1, 1), (2, 1), (4, 1), (5, 1), (7, 2), (12, 1), (13, 1)]


def test_repeated_rows_ties_and_empty_tables(spark):
    assert run(spark, [(1, ITEM), (1, ITEM)], [(1, ITEM), (2, ITEM)]) == [(1, 1), (1, 1), (1, 2), (1, 2)]
    assert run(spark, [], [(1, ITEM)]) == [] and run(spark, [(1, ITEM)], []) == []


def test_tiles_do_not_overlap_and_are_ranked():
    rng = np.random.default_rng(1)
    for _ in range(50):
        d, i = rng.integers(1, 4, 60), rng.integers(1, 4, 40)
        seeds = [(a, b) for a in range(56) for b in range(36) if (d[a : a + 5] == i[b : b + 5]).all()]
        if not seeds:
            continue
        marked = L.tiles(d, i, L.matches(*map(np.array, zip(*seeds))))
        runs = [r for t in marked for r in t]
        for k in (0, 1):
            places = [p + x for t in runs for p in [t[k]] for x in range(t[2])]
            assert len(places) == len(set(places))
        assert all((d[a : a + n] == i[b : b + n]).all() for a, b, n in runs)
        assert [L.span(t) for t in marked] == sorted(map(L.span, marked), reverse=True)


def leaks_of(spark, docs, **kw):
    rows = L.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(1, LONG)], "item_id long, text string"), **kw).collect()
    return {r.doc_id: (round(r.coverage, 2), r.longest) for r in rows}


LONG = " ".join(f"w{k}" for k in range(60))


def test_coverage_catches_reordered_passages(spark):
    """Six blocks of ten words in reverse order: no passage of twelve, yet all of the item."""
    w = LONG.split()
    reordered = " zz ".join(" ".join(w[k : k + 10]) for k in range(50, -1, -10))
    half = " ".join(w[:8] + ["zz", "zz"] + w[30:38])
    assert leaks_of(spark, [reordered, half]) == {}
    assert leaks_of(spark, [reordered, half], threshold=0.5) == {0: (1.0, 10)}
    assert leaks_of(spark, [reordered, half], threshold=0.25) == {0: (1.0, 10), 1: (0.27, 8)}


def test_words_put_in_left_out_or_exchanged(spark):
    w = LONG.split()
    put_in = " ".join(x + (" zz" if k % 9 == 8 else "") for k, x in enumerate(w))
    left_out = " ".join(x for k, x in enumerate(w) if k % 9 != 8)
    exchanged = " ".join("zz" if k % 6 == 5 else x for k, x in enumerate(w))
    too_often = " ".join("zz" if k % 5 == 4 else x for k, x in enumerate(w))
    got = leaks_of(spark, [put_in, left_out, exchanged, too_often])
    assert set(got) == {0, 1, 2} and got[0][1] >= 59 and got[2][1] >= 59
