import pytest

from veritide.llm import queries, sentences as S

TRAIN = [
    "We met at 3 p.m. and left. The table shows it. Our team agreed! The list is long? A report follows.\n\nThe end, approx. five, etc., was near. Our plan holds.",
    "Our file closed at 5 p.m.\n\nThe bank opened at 9 p.m.\n\nOur list grew.", "She said “no” at 4 p.m. sharp. The U.S. chapters agreed. Dr. Lind asked. The bank waits. Our file grows.", "会员部门很晚才发送。捐款表单很晚！旧的模板重复。她说：“好。行！”然后挂断了电话。", "寄付フォームは遅い。古い雛形は良い。",
]
CASES = [
    ("One here. Our two there.", ["One here.", "Our two there."]), ("Dr. Lind asked Mr. Oak. The bank waits.", ["Dr. Lind asked Mr. Oak.", "The bank waits."]),
    ("It costs approx. $ 5.50 per seat, i.e. little, as of Jan. 9, for the U.S. chapters. The bank waits.", ["It costs approx. $ 5.50 per seat, i.e. little, as of Jan. 9, for the U.S. chapters.", "The bank waits."]),
    ("We met at 3 p.m. sharp. The bank waits at 4 p.m. Our file grows.", ["We met at 3 p.m. sharp.", "The bank waits at 4 p.m.", "Our file grows."]),
    ("“The file grows. The bank waits!” said the clerk. Our end.", ["“The file grows. The bank waits!” said the clerk.", "Our end."]), ("It failed (see fig. 8. It was redrawn) twice. Our end.", ["It failed (see fig. 8. It was redrawn) twice.", "Our end."]),
    ("Wow?!The bank waits", ["Wow?!", "The bank waits"]), ("Well ... the bank waits... The file grows.", ["Well ... the bank waits...", "The file grows."]), ("A line\nthat goes on. The end.\nOur next", ["A line\nthat goes on.", "The end.", "Our next"]),
    ("Title here\n\nThe bank waits.\r\n\r\nOur end", ["Title here", "The bank waits.", "Our end"]), ("Steps:\n- one. Two.\n- three\n- four", ["Steps:", "- one. Two.", "- three", "- four"]), ("(1) One! Two.\n(2) Three", ["(1) One! Two.", "(2) Three"]),
    ("Das war die 3. Mahnung! Am 6. Oktober ging es z. B. los.", ["Das war die 3. Mahnung!", "Am 6. Oktober ging es z. B. los."]), ("Κόστισε 3.494,50 ευρώ· ποιος το ενέκρινε; Η λίστα.", ["Κόστισε 3.494,50 ευρώ· ποιος το ενέκρινε;", "Η λίστα."]),
    ("لماذا حدث ذلك مرة أخرى؟ بلغ الفرق 85.2 بالمئة.", ["لماذا حدث ذلك مرة أخرى؟", "بلغ الفرق 85.2 بالمئة."]), ("यह है। डॉ. Lind ने कहा।", ["यह है।", "डॉ. Lind ने कहा।"]), ("ทีมสมาชิก ระบบใช้เวลา 68 นาที", ["ทีมสมาชิก", "ระบบใช้เวลา 68 นาที"]),
    ("会员部门很晚才发送。她说：“好。行！”然后挂断了电话。捐款表单很晚！", ["会员部门很晚才发送。", "她说：“好。行！”然后挂断了电话。", "捐款表单很晚！"]), ("寄付フォームは「良い。遅い。」と言いました。古い雛形は良い。", ["寄付フォームは「良い。遅い。」と言いました。", "古い雛形は良い。"]),
    ("An \"open quote. The bank waits. Our end.", ["An \"open quote.", "The bank waits.", "Our end."]), ("", []), (" \n\t", []), ("x", ["x"]),
]


@pytest.fixture(scope="module")
def model(spark):
    return S.fit(spark.createDataFrame([(t,) for t in TRAIN * 3] + [(None,)], "text string"))


@pytest.mark.parametrize("text,want", CASES)
def test_units(model, text, want):
    got = S.Splitter(model)(text)
    assert [text[a:b] for a, b in got] == want


def test_rows_cover_all_but_blanks(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text}
    cover = {d: bytearray(len(t)) for d, t in docs.items()}
    for r in queries.p8_found(spark, data).collect():
        t = docs[r.doc_id]
        assert not t[r.start_char].isspace() and not t[r.end_char - 1].isspace()
        assert not any(cover[r.doc_id][r.start_char : r.end_char])
        cover[r.doc_id][r.start_char : r.end_char] = b"\1" * (r.end_char - r.start_char)
    assert all(c or x.isspace() for d, t in docs.items() for c, x in zip(cover[d], t))


def test_posteriors_are_exact(model):
    """Forward-backward against the sum over all assignments of events."""
    import itertools
    import math

    sp = S.Splitter(model)
    text = "We met at 3 p.m. Oak. Go. The bank waits. No. 5 is it. Our end."
    ps = S.places(text, 0, len(text), sp.t)
    got, odds = sp.posteriors(text, ps), [max(-30.0, min(30.0, sp.odds(x))) for x in ps]
    one = [len(text[x.next : y.end].split()) < 2 for x, y in zip(ps, ps[1:])]
    weight = lambda e: math.prod(1 / (1 + math.exp(-o if x else o)) for o, x in zip(odds, e)) * math.prod(model["short"] if s and e[i] and e[i + 1] else 1 for i, s in enumerate(one))
    every = list(itertools.product((0, 1), repeat=len(ps)))
    assert any(one)
    for i, p in enumerate(got):
        assert p == pytest.approx(sum(weight(e) for e in every if e[i]) / sum(map(weight, every)), abs=1e-9)


@pytest.fixture(scope="module")
def corpus(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return docs, S.fit(docs), {r.doc_id: r.text for r in docs.collect() if r.text}


def test_the_model_decides(corpus):
    """Ablation: without the counts of words and classes many rows are others."""
    _, m, texts = corpus
    flat = m | {"counts": {}, "after": dict.fromkeys(m["after"], 0.0), "before": dict.fromkeys(m["before"], 0.0)}
    full, none = ({(d, s) for d, t in texts.items() for s in S.Splitter(x)(t)} for x in (m, flat))
    assert len(full - none) > 0.04 * len(full)


def test_forward_backward_decides(model):
    """Neighbouring events share how seldom a sentence is one word: what a place would be by itself, its neighbours turn round."""
    sp = S.Splitter(model | {"short": 1e-9})
    text = "We met at noon. Oak. The bank waits."
    ps = S.places(text, 0, len(text), sp.t)
    alone = [sp.odds(x) > 0 for x in ps]
    assert alone == [True, True] and [p > 0.5 for p in sp.posteriors(text, ps)] != alone


def test_unpunctuated_text_is_split(corpus):
    """Sentences of held texts strung together without any end mark: boundaries come back from the posteriors."""
    _, m, texts = corpus
    sp, want, got, both = S.Splitter(m), 0, 0, 0
    for t in texts.values():
        if any(c in t for c in "\"“”«»„()（）「」[]\n") or any(ord(c) > 0x2E80 or "฀" <= c <= "๿" for c in t):
            continue
        parts = [t[a:b].rstrip(".!?।؟") for a, b in sp(t)]
        if len(parts) < 3:
            continue
        starts = {sum(len(p) + 1 for p in parts[:k]) for k in range(1, len(parts))}
        found = {a for a, _ in sp(" ".join(parts))} - {0}
        want, got, both = want + len(starts), got + len(found), both + len(starts & found)
    assert want > 80 and both >= 0.8 * want and both >= 0.95 * got


def test_a_large_model_stays_a_table_and_gives_the_same(spark, corpus):
    docs, small, _ = corpus
    large = S.fit(docs, model_size=10)
    assert "table" in large and "counts" not in large and large["marks"] == small["marks"]
    docs = docs.unionByName(docs.limit(20))
    rows = lambda m: sorted(tuple(r) for r in S.split(docs, m).collect())
    assert rows(large) == rows(small)


def test_no_limit_of_length_changes_an_answer(corpus):
    """Inputs on either side of former limits: long words, long gaps, short blocks with two sentences."""
    _, m, _ = corpus
    sp = S.Splitter(m)
    cut = lambda t: [t[a:b] for a, b in sp(t)]
    assert cut("We left early. The bank file falls behind.") == ["We left early.", "The bank file falls behind."]
    for n in (10, 23, 25, 59, 61, 200):
        w = "x" * n
        assert cut(f"The bank file met {w}. The bank file falls behind.") == [f"The bank file met {w}.", "The bank file falls behind."]
        assert cut("折" * n + "。旧的模板很晚。") == ["折" * n + "。", "旧的模板很晚。"]


def test_empty_table_repeated_rows_and_long_text(spark, model):
    df = spark.createDataFrame([(1, None), (2, "One. Our two."), (2, "One. Our two."), (3, "The bank waits. " * 20000)], "doc_id long, text string")
    n = {r.doc_id: r["count"] for r in S.split(df, model).groupBy("doc_id").count().collect()}
    assert n == {2: 4, 3: 20000}
    assert S.split(df.limit(0), S.fit(df.limit(0))).count() == 0
