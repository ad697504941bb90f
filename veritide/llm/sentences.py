"""Sentence boundaries across languages and scripts, by a hidden-event n-gram language model.

Between two tokens stands an event, boundary or none. `fit` counts over the whole corpus which words begin and end sentences
where the definition leaves no doubt (edges of paragraphs and lines after a mark), which stand within them, alone and in
pairs, and every other place by its classes: kind of mark, quotation, blank, class of the word before and after. The
chance of a boundary at each kind of mark comes from these classes by expectation maximisation. `split` gives every place the odds

    P(event | mark) * P(word before | event, mark) * P(word after | event, word before)

where words back off to their classes, lets neighbouring events share how seldom a sentence has one word, and
forward-backward posteriors decide: at marks, and at blanks without any mark. What the definition fixes is clamped: blank
lines, list items, line breaks without an end mark, text within quotation marks or brackets, blanks between Thai letters.

Counting pre-aggregates in each task before its shuffle. Up to `model_size` counts travel as a broadcast; a larger model stays
a written table, and each text gets the counts of its own words by a join: same result, nothing is left out.

Defined results: null, empty and blank texts give no rows; offsets are code points; an unclosed quote or bracket does not
suppress boundaries; `\\r\\n`, `\\r`, U+2028 and U+0085 are line breaks, U+2029 a blank line; repeated rows give their rows each.
"""
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir

END = ".!?…。．！？｡।॥؟۔‼⁇⁈⁉።។"
CLOSERS = "\"'”’»›）)】」』〉》]］｝}“‘"
# Brackets and quotation marks with what may close them.
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "‚": "‘", "〈": "〉"}
# Usual abbreviations and titles, known to the model as classes of words before a dot.
ABBREVIATIONS = """vs no nr vol fig cf approx excl incl e.g i.e z.b d.h bzw ca usw art p pp éd ed sect ch
etc co ltd inc jan feb mar apr jun jul aug sep sept oct nov dec u.s u.k a.m p.m ph.d п т.е т.д г ч стр им ул u.a vgl abs tel av núm pág hr str"""
TITLES = "mr mrs ms dr prof st sr sra srta m mme mlle fr hr डॉ г-н г-жа"
_NL = "(?:\\r\\n|\\n|\\r(?!\\n)|\\u2028|\\x85)"
_KNOWN, _TITLED = frozenset(ABBREVIATIONS.split()), frozenset(TITLES.split())
#: Counts a class of word before a dot starts with: (within a sentence, at its end).
_BEFORE_PRIOR = {"title": (50.0, 0.05), "known": (30.0, 4.0), "letter": (60.0, 0.3), "number": (5.0, 3.0), "short": (1.0, 1.0), "word": (1.0, 20.0), "none": (1.0, 1.0)}
#: A dot after a number is as often an ordinal's or an item's; a capital after it tells nothing, only the word itself does.
_ORDINAL = -1.5
#: After a quotation or bracket closed with its own mark, in scripts without capitals: it began within the sentence, or with it.
_CLOSED = {"inside": -1.0, "fresh": 1.0}
_KEY, _ASKING = 40, frozenset("!?！？‼⁇⁈⁉؟;")


def _tools() -> dict:
    import regex

    return {
        "gap": re.compile(rf"{_NL}[^\S\r\n]*{_NL}\s*|\s* \s*"),
        "line": re.compile(_NL),
        "bullet": regex.compile(r"[^\S\r\n]*(?:[-*+•‣◦▪●○・·–—][^\S\r\n]+|#{1,6}[^\S\r\n]+|(?P<num>\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4}|[一二三四五六七八九十]{1,3})[)）、]|\d{1,3}[.．]|（\d{1,3}）)[^\S\r\n]*(?=\S)|[①-⑳])"),
        "mark": regex.compile(rf"[{re.escape(END)}]+(?:\s?[!?]+)?|(?<=\p{{Greek}}[{re.escape(CLOSERS)}]*);|;"),
        "deva": regex.compile(r"\p{Devanagari}"),
        "word": regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}\xad]*(?:[.'’\-_][\p{L}\p{M}\p{N}\xad]+)*"),
        "plain": regex.compile(r"(?<=[\p{L}\p{M}\p{N}])[^\S\r\n  \x85]+(?=[\p{Lu}\p{Lt}\p{Lm}\p{Lo}])"),
        "thai": regex.compile(r"(?<=[\p{Thai}&&[\p{L}\p{M}]])[^\S\r\n  \x85]+(?=[\p{Thai}&&\p{L}])", regex.V1),
        "wide": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
        "greek": regex.compile(r"\p{Greek}"),
    }


def _key(word: str) -> str:
    """The word composed and without soft hyphens, as a key of counts; a very long one by a digest."""
    if not word.isascii():
        word = unicodedata.normalize("NFC", word.replace("\xad", ""))
    if len(word) <= _KEY:
        return word
    import xxhash

    return word[:8] + "~" + xxhash.xxh128_hexdigest(word.encode("utf-8", "surrogatepass"))


def _next_word(text: str, i: int, t: dict) -> str:
    """The word at i (after openers); of scripts without blanks the first two characters; `0` for a number."""
    m = t["word"].match(text, i)
    if not m:
        return ""
    w = m[0]
    if t["wide"].match(w):
        return w[:2]
    return "0" if w[0].isdigit() and not any(c.isalpha() for c in w) else _key(w)


_STOPS = frozenset(END + CLOSERS + "".join(PAIRS))


def _prev_word(text: str, i: int, floor: int = 0) -> str:
    """What stands before the mark at i without blanks, in small letters, inner dots kept; `0` for a number."""
    a = i
    while a > floor and (text[a - 1].isalnum() or text[a - 1] in ".°º\xad" or (ord(text[a - 1]) > 0x300 and not text[a - 1].isspace() and text[a - 1] not in _STOPS)):
        a -= 1
    w = text[a:i].replace("\xad", "").strip(".").lower()
    if len(w) == 1 and a >= 3 and text[a - 1] == " " and text[a - 2] == ".":  # z. B., т. е., J. R.
        b = a - 2
        while b > 0 and text[b - 1].isalpha() and a - b < 5:
            b -= 1
        if a - 2 - b == 1:
            w = text[b : a - 2].lower() + "." + w
    return "0" if w and all(c.isdigit() or c in ".," for c in w) else _key(w)


def before_class(w: str) -> str:
    """Class of a word before a dot."""
    if not w:
        return "none"
    if w in _TITLED:
        return "title"
    if w in _KNOWN or re.fullmatch(r"(?:[^\W\d_]{1,3}\.)+[^\W\d_]{1,3}", w):
        return "known"
    if w == "0":
        return "number"
    if len(w.replace(".", "")) == 1:
        return "letter"
    return "short" if len(w) <= 3 and ord(w[0]) < 0x590 else "word"


def after_class(lead: str, word: str) -> str:
    """Class of what follows a place."""
    if lead.islower():
        return "upper" if word[1:].lower() != word[1:] else "lower"
    if lead.isupper():
        return "upper"
    if lead.isdigit():
        return "digit"
    if not lead.isalpha():
        return "sign"
    return "wide" if ord(lead) > 0x2E80 and not "가" <= lead <= "힣" else "uncased"


def mark_class(mark: str) -> str:
    """Class of an end mark; `` (empty) is a blank without any."""
    if not mark:
        return ""
    if not _ASKING.isdisjoint(mark):
        return "?"
    if "…" in mark or mark.startswith(".."):
        return "…"
    return "." if mark[0] == "." else "。"


def blocks(text: str, t: dict) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of what no sentence crosses: paragraphs, and within them list items; whole: one unit."""
    at = 0
    for m in [*t["gap"].finditer(text), None]:
        a, b = at, m.start() if m else len(text)
        at = m.end() if m else b
        if not text[a:b].strip():
            continue
        starts = [a, *(x.end() for x in t["line"].finditer(text, a, b))]
        bullets = [(s, t["bullet"].match(text, s, b)) for s in starts]
        shape = lambda x: re.sub(r"\w+", "0", x[0].strip()) if x else None
        counts = Counter(shape(x) for _, x in bullets if x)
        items = []
        for k, (s, x) in enumerate(bullets):
            if not x or x.end() >= b or not text[s : starts[k + 1] if k + 1 < len(starts) else b].strip():
                continue
            p = s - 1
            while p >= a and text[p].isspace():
                p -= 1
            fresh = p < a or text[p] in END + ";:：" + CLOSERS or counts[shape(x)] > 1
            letter = x["num"] and x["num"][0].isalpha() and not x["num"].endswith((")", "）", "、"))
            if fresh and not letter:
                items.append(s)
        listed = set(items)
        edges = sorted({a, *items, b})
        for s, e in zip(edges, edges[1:]):
            if not text[s:e].strip():
                continue
            if s in listed:
                # An item goes on over line breaks until an end mark at the end of a line.
                cut, heading = e, text[s:e].lstrip().startswith("#")
                for x in t["line"].finditer(text, s, e):
                    p = x.start() - 1
                    while p >= s and (text[p].isspace() or text[p] in CLOSERS):
                        p -= 1
                    if (p >= s and text[p] in END or heading) and text[x.end() : e].strip():
                        cut = x.end()
                        break
                yield s, cut, True
                if cut < e:
                    yield cut, e, False
            else:
                yield s, e, False


_PAIRED = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values()) + '"＂') + "]")


def inner(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Spans of quoted or bracketed text within [a, b), and for every closing place its opening place."""
    spans, stack, closes, straight = [], [], {}, None
    for m in _PAIRED.finditer(text, a, b):
        i, c = m.start(), m[0]
        if c == '"' or c == "＂":
            if straight is None:
                straight = i
            else:
                spans.append((straight, i))
                closes[i] = straight
                straight = None
            continue
        hit = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRS[text[stack[k]]]), None)
        if hit is not None:
            spans.append((stack[hit], i))
            closes[i] = stack[hit]
            del stack[hit:]
        elif c in PAIRS:
            stack.append(i)
    return spans, closes


class Place:
    """A gap where an event may stand: before `next`, after the mark (if any) that begins at `i`."""

    __slots__ = ("i", "end", "next", "mark", "lead", "blank", "brk", "quoted", "word", "prev", "after", "before", "fixed")


def places(text: str, a: int, b: int, t: dict) -> list[Place]:
    """The places of a block in order: after marks, and blanks between words before a word that may begin a sentence."""
    spans, closes = inner(text, a, b)
    depth, out, thai = bytearray(b - a + 1), [], [m.end() for m in t["thai"].finditer(text, a, b)]
    for s, e in spans:
        depth[s + 1 - a : e - a + 1] = b"\1" * (e - s)
    taken = set()
    for m in t["mark"].finditer(text, a, b):
        i, j = m.start(), m.end()
        if m[0] == ";" and not (i > a and t["greek"].search(text, max(a, i - 3), i)):
            continue
        if m[0] == "." and i > a and t["deva"].match(text[i - 1]):
            continue
        end, opened = j, None
        while end < b and text[end] in CLOSERS:
            if end in closes:
                opened = closes[end]
            elif text[end] in PAIRS:
                break
            end += 1
        if end > a and depth[end - a] and end < b and end not in closes or depth[end - 1 - a] and (end - 1) not in closes:
            continue  # within quotation marks or brackets
        k = end
        while k < b and (text[k].isspace() or text[k] in "​﻿"):
            k += 1
        if k >= b:
            continue
        first = text[k]
        if first in ",;:、，；：،)" or first in END and k == end:
            continue
        p = k
        while p < b and (text[p] in PAIRS or text[p] in "\"'¿¡" or p > k and text[p].isspace()):
            p += 1
        x = Place()
        # Full-width marks need no blank.
        x.i, x.end, x.next, x.mark, x.blank = i, end, k, mark_class(m[0]), k > end or ord(text[j - 1]) > 0x2E80
        x.brk, x.lead = bool(t["line"].search(text, end, k)), text[p] if p < b else first
        x.word, x.prev, x.fixed = _next_word(text, p, t), None, None
        if x.word == "0" and i > a and ord(text[i - 1]) > 0x2E80:
            x.word = "0 wide"  # a number in a text without blanks
        x.quoted = "no"
        if end > j and opened is not None:
            q = opened - 1
            while q >= a and text[q].isspace():
                q -= 1
            x.quoted = "fresh" if q < a or text[q] in END + CLOSERS else "inside"
        x.after = after_class(x.lead, x.word)
        x.before = ""
        if x.mark == ".":
            if not x.blank and x.quoted == "no":
                continue  # decimals, addresses, file names: no token ends here
            x.prev = _prev_word(text, i, a)
            x.before = before_class(x.prev)
        out.append(x)
        taken.add(k)
    for k in thai:
        if not depth[k - 1 - a]:
            x = Place()
            x.i, x.end, x.next, x.mark, x.blank, x.brk, x.lead, x.quoted, x.word, x.prev, x.after, x.before, x.fixed = k, k, k, "", True, False, text[k], "no", "", "", "uncased", "", True
            out.append(x)
            taken.add(k)
    for m in t["plain"].finditer(text, a, b):
        k = m.end()
        lead = text[k]
        # A small letter of a script with capitals begins no sentence by any odds the counts can give.
        if lead.islower() or depth[k - a] or k in taken:
            continue
        x = Place()
        x.i, x.end, x.next, x.mark, x.blank, x.brk, x.lead, x.quoted, x.fixed = m.start(), m.start(), k, "", True, False, lead, "no", None
        x.word, x.prev = _next_word(text, k, t), _last_word(text, m.start(), a, t)
        x.after, x.before = after_class(lead, x.word), ""
        out.append(x)
    out.sort(key=lambda x: x.next)
    return out


def _last_word(text: str, i: int, floor: int, t: dict) -> str:
    """The word that ends at i; of scripts without blanks its last two characters."""
    a = i
    while a > floor and not text[a - 1].isspace() and text[a - 1] not in _STOPS and i - a <= _KEY * 4:
        a -= 1
    w = text[a:i]
    return w[-2:] if w and t["wide"].match(w[-1]) else _key(w)


def count_text(text: str, t: dict, counts: Counter) -> None:
    """Adds a text's counts.

    start, end       words at certain edges: of blocks, and of lines after a mark
    mid, abbr        words within: not after any place; before a dot that a small letter or comma follows
    pair, left       words before and after a blank without mark, together and the first alone, where the second might begin a sentence
    S, M             classes of `start` and `mid`;  E, A: of `end` and `abbr`;  cell: classes of an open place; size: words of a block
    """
    for a, b, whole in blocks(text, t):
        if whole:
            continue
        ps = places(text, a, b, t)
        at = {p.next for p in ps if p.mark}
        e = b
        while e > a and text[e - 1].isspace():
            e -= 1
        p = a
        while p < e and (text[p].isspace() or text[p] in PAIRS or text[p] in "\"'¿¡"):
            p += 1
        first = _next_word(text, p, t)
        if first:
            counts["start", first] += 1
            counts["S", after_class(text[p], first)] += 1
        closed = e
        while closed > a and text[closed - 1] in CLOSERS:
            closed -= 1
        if closed > a and text[closed - 1] == "." and (closed < 2 or text[closed - 2] not in END):
            w = _prev_word(text, closed - 1, a)
            counts["end", w] += 1
            counts["E", before_class(w)] += 1
        elif closed > a and text[closed - 1].isalnum():
            counts["bare", ""] += 1
        for x in ps:
            if x.fixed is not None or not x.mark:
                if x.mark == "" and x.fixed is None:
                    counts["pair", f"{x.prev}\t{x.word}"] += 1
                    counts["left", x.prev] += 1
                continue
            counts["cell", f"{x.mark}|{x.quoted}|{int(x.blank)}|{x.after}|{x.before}"] += 1
            sure = x.quoted == "no" and (x.brk or x.mark in "?。" and x.blank) and x.after != "lower" and x.mark != "…"
            if sure and x.before not in ("title", "letter", "known", "number"):
                counts["start", x.word] += 1
                counts["S", x.after] += 1
            elif x.mark == "." and (x.after == "lower" or x.after == "digit" and x.before in ("known", "letter", "short")):
                counts["abbr", x.prev] += 1
                counts["A", x.before] += 1
        for m in re.finditer(r"\.(?=[,;:])", text[a:b]):
            w = _prev_word(text, a + m.start(), a)
            counts["abbr", w] += 1
            counts["A", before_class(w)] += 1
        n = low = 0
        for m in t["word"].finditer(text, a, b):
            w = m[0]
            n += 1
            if w.islower() and w[0].isalpha():
                low += 1
                continue
            s = m.start()
            if s == p or s in at:
                continue
            lead = w[0]
            if t["wide"].match(lead):
                if text[s - 1] not in _STOPS and text[s - 1] != "\n":
                    counts["mid", w[:2]] += 1
                    counts["M", "wide"] += 1
                for x in range(2, len(w) - 1, 2):
                    counts["mid", w[x : x + 2]] += 1
                    counts["M", "wide"] += 1
                continue
            if text[s - 1] in _STOPS or text[s - 1] in "¿¡" or s > 1 and text[s - 1].isspace() and text[s - 2] in _STOPS:
                continue
            c = after_class(lead, w)
            counts["M", c] += 1
            if c != "lower":
                counts["mid", "0" if w.isdigit() else _key(w)] += 1
        # Small words but for those that begin the block or follow a mark.
        low -= first.islower() + sum(x.after == "lower" and bool(x.mark) for x in ps)
        if low > 0:
            counts["M", "lower"] += low
        counts["size", "1" if n == 1 else "2"] += 1


_SMALL = ("S", "M", "E", "A", "cell", "size", "bare")


def _solve(small: dict[str, dict[str, float]], sums: dict[str, float]) -> dict:
    """Class ratios and, by expectation maximisation over all open places, log odds of a boundary at each kind of mark."""
    def ratio(yes: dict, no: dict, prior: dict) -> dict[str, float]:
        ys, ns = (sum(d.values()) + sum(prior.values()) for d in (yes, no))
        return {k: math.log((yes.get(k, 0) + prior[k]) / ys) - math.log((no.get(k, 0) + prior[k]) / ns) for k in prior}

    after = ratio(small["S"], small["M"], dict.fromkeys(("upper", "lower", "digit", "wide", "uncased"), 1.0)) | {"sign": 0.0}
    ends = {k: small["E"].get(k, 0) + y for k, (_, y) in _BEFORE_PRIOR.items()}
    within = {k: small["A"].get(k, 0) + n for k, (n, _) in _BEFORE_PRIOR.items()}
    before = {k: math.log(ends[k] / sum(ends.values())) - math.log(within[k] / sum(within.values())) for k in _BEFORE_PRIOR}
    before["number"] = min(before["number"], _ORDINAL)
    cells = [(*k.split("|"), n) for k, n in small["cell"].items()]
    marks = {}
    for m, q in {(c[0], c[1]) for c in cells} | {(m, q) for m in ".?…。" for q in ("no", "fresh", "inside")}:
        # Beginning at what the mark is for; blanks and classes of words around move it.
        o = {".": 1.0, "?": 2.0, "…": 0.0, "。": 3.0}[m] + (0.0 if q != "inside" else -1.0)
        for _ in range(30):
            yes = no = 1.0
            for mm, qq, blank, aft, bef, n in cells:
                if (mm, qq, blank) == (m, q, "1") and (q == "no" or aft not in ("uncased", "wide", "sign")):
                    z = o + after[aft] + before.get(bef, 0.0)
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                    yes, no = yes + n * p, no + n * (1 - p)
            o = math.log(yes / no)
        marks[m, q] = o
    bare, gaps, size = small["bare"].get("", 0.0), sums.get("pair", 0.0), small["size"]
    return {"after": after, "before": before, "marks": marks, "bare": math.log((bare + 0.1) / (gaps + bare + 100.0)),
            "short": (size.get("1", 0) + 1) / (sum(size.values()) + 10), "sums": sums}


def fit(docs: DataFrame, text: str = "text", model_size: int = 400_000) -> dict:
    """The event model of a corpus, counted over all of all texts.

    With at most `model_size` distinct counts they are in the model, else in a written table that `split` joins.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, counts = _tools(), Counter()
        flush = lambda: pd.DataFrame([(k, w, n) for (k, w), n in counts.items()], columns=["kind", "word", "n"])
        for b in batches:
            for x in b["text"]:
                count_text(x, t, counts)
            if len(counts) > 500_000:
                yield flush()
                counts.clear()
        yield flush()

    raw = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInPandas(run, "kind string, word string, n long")
    path = shared_dir(docs.sparkSession, "sentence-counts")
    raw.groupBy("kind", "word").agg(F.sum("n").alias("n")).write.parquet(path)
    table = docs.sparkSession.read.schema("kind string, word string, n long").parquet(path)
    small: dict[str, dict[str, float]] = {k: {} for k in _SMALL}
    for k, w, n in table.where(F.col("kind").isin(*_SMALL)).collect():  # classes: a few hundred rows
        small[k][w] = float(n)
    words = table.where(~F.col("kind").isin(*_SMALL))
    by_kind = words.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    model = _solve(small, {r.kind: float(r.n) for r in by_kind})
    if sum(r["rows"] for r in by_kind) <= model_size:
        return model | {"counts": {(k, w): n for k, w, n in words.collect()}}
    return model | {"table": words}


class Splitter:
    """Sentences of one text under an event model."""

    #: Weight of the classes against the counts of a word.
    BACKOFF = 0.5

    def __init__(self, model: dict):
        self.m, self.t, self.counts = model, _tools(), model.get("counts", {})

    def _after(self, x: Place) -> float:
        """log P(word after | boundary) / P(word after | none), backing off to its class; after a word, none goes by the pair."""
        get, sums, k = self.counts.get, self.m["sums"], self.BACKOFF
        r = self.m["after"][x.after]
        if x.before == "number" and x.after == "upper" or x.quoted != "no" and x.after in ("uncased", "wide"):
            r = 0.0
        if not x.word:
            return r
        r = math.exp(r)
        starts, mids = sums.get("start", 1.0), max(1.0, sums.get("mid", 1.0))
        yes, no = get(("start", x.word), 0), get(("mid", x.word), 0) * min(1.0, starts / mids)
        odds = math.log((yes + k * r) / (no + k))
        if not x.mark and x.prev is not None:
            # n-gram of the word before: what it goes on with more often than words do by themselves.
            left, pair = get(("left", x.prev), 0), get(("pair", f"{x.prev}\t{x.word}"), 0)
            base = (get(("mid", x.word), 0) + 1.0) / (mids + 1000.0)
            odds -= math.log((pair + 2.0 * base) / (left + 2.0) / base)
        return odds

    def odds(self, x: Place) -> float:
        """log P(boundary, words) / P(none, words) of a place."""
        if x.fixed is not None:
            return 12.0 if x.fixed else -12.0
        m, k = self.m, self.BACKOFF
        if not x.mark:
            return m["bare"] + self._after(x)
        o = m["marks"][x.mark, x.quoted] if x.quoted == "no" or x.after not in ("uncased", "wide", "sign") else _CLOSED[x.quoted]
        o += self._after(x) + (0.0 if x.blank or x.after == "wide" and x.mark != "…" else -3.0) + (1.0 if x.brk else 0.0)
        if x.before == "number":
            o += m["before"]["number"]
        elif x.mark == "." and (x.quoted == "no" or x.after not in ("uncased", "wide", "sign")):
            r = math.exp(m["before"][x.before])
            o += math.log((self.counts.get(("end", x.prev), 0) + k * r) / (self.counts.get(("abbr", x.prev), 0) + k))
        return o

    def posteriors(self, text: str, ps: list[Place]) -> list[float]:
        """Forward-backward over the events of a block; how seldom a sentence is one word lies between neighbours."""
        if not ps:
            return []
        yes, no = [], []
        for x in ps:
            o = math.exp(max(-30.0, min(30.0, self.odds(x))))
            yes.append(o / (1 + o))
            no.append(1 / (1 + o))
        # pair[k]: factor of boundaries at both k and k + 1; all other pairs of events have 1.
        pair, short = [], self.m["short"]
        for x, y in zip(ps, ps[1:]):
            one = y.end - x.next < 60 and x.after != "wide" and x.fixed is None and y.fixed is None and len(text[x.next : y.end].split()) < 2
            pair.append(short if one else 1.0)
        f0, f1 = [no[0]], [yes[0]]
        for k in range(1, len(ps)):
            p, q = no[k] * (f0[-1] + f1[-1]), yes[k] * (f0[-1] + f1[-1] * pair[k - 1])
            f0.append(p / (p + q))
            f1.append(q / (p + q))
        out, b0, b1 = [0.0] * len(ps), 1.0, 1.0
        for k in range(len(ps) - 1, -1, -1):
            out[k] = f1[k] * b1 / (f0[k] * b0 + f1[k] * b1)
            if k:
                p, q = no[k] * b0, yes[k] * b1
                b0, b1 = p + q, p + q * pair[k - 1]
                b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
        return out

    def __call__(self, text: str) -> list[tuple[int, int]]:
        if not text or not text.strip():
            return []
        out = []
        for a, b, whole in blocks(text, self.t):
            cuts = []
            if not whole:
                ps = places(text, a, b, self.t)
                cuts = [x.next for x, p in zip(ps, self.posteriors(text, ps)) if p > 0.5]
            edges = [a, *cuts, b]
            for s, e in zip(edges, edges[1:]):
                while s < e and text[s].isspace():
                    s += 1
                while e > s and text[e - 1].isspace():
                    e -= 1
                if e > s:
                    out.append((s, e))
        return out


def _needed(text: str, t: dict) -> list[str]:
    """Keys (kind and word) of the counts that a text's places look up."""
    keys = set()
    for a, b, whole in blocks(text, t):
        if not whole:
            for x in places(text, a, b, t):
                if x.fixed is None:
                    keys.update((f"start\t{x.word}", f"mid\t{x.word}"))
                    if not x.mark:
                        keys.update((f"left\t{x.prev}", f"pair\t{x.prev}\t{x.word}"))
                    elif x.mark == ".":
                        keys.update((f"end\t{x.prev}", f"abbr\t{x.prev}"))
    return sorted(keys)


def _with_counts(src: DataFrame, words: DataFrame) -> DataFrame:
    """Adds `counts`, the counts each text needs, by one equi-join of distinct keys of distinct texts."""
    kinds = {k: i for i, k in enumerate(("start", "mid", "end", "abbr", "left", "pair"))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tools()
        for b in batches:
            rows = [(d, *key.split("\t", 1)) for d, x in zip(b["digest"], b["text"]) for key in _needed(x, t)]
            yield pd.DataFrame(rows, columns=["digest", "kind", "word"])

    keyed = src.withColumn("digest", F.sha2("text", 256))
    want = keyed.select("digest", "text").dropDuplicates(["digest"]).mapInPandas(run, "digest string, kind string, word string")
    got = want.join(words.where(F.col("kind").isin(*kinds)), ["kind", "word"]).groupBy("digest").agg(
        F.collect_list(F.concat_ws("\t", F.col("n").cast("string"), "kind", "word")).alias("counts"))
    return keyed.join(got, "digest", "left").drop("digest")


def split(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence of every document."""
    sent = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "table"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(sent.value)
        for b in batches:
            rows = []
            seen: dict[str, list] = {}  # copies within a batch are split once
            for i, (k, x) in enumerate(zip(b["k"], b["text"])):
                if x not in seen:
                    if "counts" in b:
                        mine = b["counts"].iloc[i]
                        splitter.counts = {(kind, w): int(n) for n, kind, w in (c.split("\t", 2) for c in (mine if mine is not None else ()))}
                    seen[x] = splitter(x)
                rows += [(k, s, e) for s, e in seen[x]]
            yield pd.DataFrame(rows, columns=["doc_id", "start_char", "end_char"])

    src = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kind = dict(src.dtypes)["k"]
    if "table" in model:
        src = _with_counts(src, model["table"])
    return src.mapInPandas(run, f"doc_id {kind}, start_char long, end_char long")
