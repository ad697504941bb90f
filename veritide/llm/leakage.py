"""Evaluation texts leaking into training text, by greedy string tiling with Karp-Rabin seeds.

Texts become tokens without case, punctuation, spacing and invisible characters: words, or single characters in Japanese and
Chinese. Hashes of `SEED` tokens in a row are rolled over each document and met with those of the items. For each pair with
seeds the longest matches are marked first, again and again: a tile is a run of equal tokens that may cross single other
words (one put in, left out or exchanged) as long as `SEED` equal ones stand between two of them; what an earlier tile has
taken of a later one is cut off, and the rest ranked anew. The tiles decide: an item has leaked if its longest tile reaches
12 words, or 20 characters, or, with a `threshold`, if its tiles together cover that share of it, in whatever order. As
a tile of that kind always holds an exact run of five, the seeds miss none.

Items up to `block_tokens` tokens travel as one broadcast index and documents are scanned in one pass, never shuffled. More
items become a table of seeds: documents give out the seeds that pass a filter of fixed size, an equi-join by hash makes the
pairs (adaptive execution splits a seed that stands in very many texts), and each pair is tiled by itself.

Defined results: null, empty and blank texts on either side give no rows; an item shorter than the least passage leaks only
by `threshold`; repeated documents each give their rows, repeated items too; a document holding an item twice gives one row.
"""
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SEED = 5
#: Tokens looked at before (half) and after a seed.
SIGHT = 24
LEAST = {"word": 12, "char": 20}
_MULT = np.uint64(0x9E3779B97F4A7C15)


def tokenizer():
    """text -> tokens; made in the worker. Plain ASCII has nothing to fold or hide, so it takes a shorter way to the same tokens."""
    import re
    import unicodedata

    import regex

    hidden = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵ㅤﾠ︀-️]")
    token = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[[\p{L}\p{N}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}ー]]+", regex.V1)
    plain = re.compile("[a-z0-9]+")

    def run(text: str) -> list[str]:
        if not text:
            return []
        if text.isascii():
            return plain.findall(text.lower())
        return token.findall(hidden.sub("", unicodedata.normalize("NFKC", text)).casefold())

    return run


def rolling(ids: np.ndarray, k: int = SEED) -> np.ndarray:
    """Karp-Rabin hash (mod 2**64) of every k tokens in a row."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    h = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        h = h * _MULT + ids[j : j + len(h)].astype(np.uint64)
    return h


def least_tokens(tokens: list[str]) -> int:
    """Least length of a leaked passage of an item with these tokens."""
    wide = sum(len(t) == 1 and ord(t) > 0x2E80 for t in tokens)
    return LEAST["char" if wide * 2 > len(tokens) else "word"]


def build_index(items: list[tuple[int, str]]) -> dict:
    """Vocabulary, token arrays and sorted seed hashes of the items."""
    tokens, vocab, arrays, kinds = tokenizer(), {}, [], []
    for _, text in items:
        ts = tokens(text)
        kinds.append(least_tokens(ts))
        arrays.append(np.array([vocab.setdefault(t, len(vocab) + 1) for t in ts], dtype=np.int64))
    hashes = [rolling(a) for a in arrays]
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    where = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
    pad = np.full(SIGHT, -1, dtype=np.int64)
    start = np.cumsum([SIGHT, *(len(a) + SIGHT for a in arrays)])[: len(arrays)]
    flat_items = np.concatenate([pad, *(x for a in arrays for x in (a, pad))])
    return {"flat": flat_items, "start": start, "ids": [i for i, _ in items], "vocab": vocab, "arrays": arrays, "least": kinds, "hash": flat[order], "item": where[order], "at": at[order]}


def matches(d: np.ndarray, i: np.ndarray) -> list[tuple[int, int, int]]:
    """Longest exact runs (start in doc, start in item, length) from all seed places: seeds in a row on a diagonal are one run."""
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    first = np.r_[True, (np.diff(d - i) != 0) | (np.diff(d) != 1)]
    at = np.flatnonzero(first)
    n = np.diff(np.r_[at, len(d)]) + SEED - 1
    return list(zip(d[at].tolist(), i[at].tolist(), n.tolist()))


_STEPS = ((1, 1), (1, 0), (0, 1))


def chains(doc: np.ndarray, item: np.ndarray, runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Runs joined over single other words, with what equal tokens lie beyond one more such word at either end."""
    def beyond(d: int, i: int, way: int) -> tuple[int, int, int] | None:
        """The longest equal run one step away from (d, i), looked for forwards (way 1) or backwards (-1)."""
        best = None
        for sd, si in _STEPS:
            a, b, n = d + way * sd, i + way * si, 0
            while 0 <= a + way * n < len(doc) and 0 <= b + way * n < len(item) and doc[a + way * n] == item[b + way * n]:
                n += 1
            if n and (best is None or n > best[2]):
                best = (a, b, n) if way > 0 else (a - n + 1, b - n + 1, n)
        return best

    runs = sorted(runs)
    ends: dict[tuple[int, int], int] = {}
    length, before, used = [], [], [False] * len(runs)
    for k, (d, i, n) in enumerate(runs):
        prior = [ends[p] for sd, si in _STEPS if (p := (d - sd, i - si)) in ends]
        u = max(prior, key=lambda x: length[x], default=None)
        before.append(u)
        length.append(n + (length[u] if u is not None else 0))
        if u is not None:
            used[u] = True
        at = (d + n, i + n)
        if at not in ends or length[ends[at]] < length[k]:
            ends[at] = k
    out = []
    for k in range(len(runs)):
        if used[k]:
            continue
        chain, u = [], k
        while u is not None:
            chain.append(runs[u])
            u = before[u]
        chain.reverse()
        (d, i, _), (e, j, n) = chain[0], chain[-1]
        left, right = beyond(d - 1, i - 1, -1), beyond(e + n, j + n, 1)
        out.append(([left] if left else []) + chain + ([right] if right else []))
    return out


def span(chain: list[tuple[int, int, int]]) -> int:
    """Length of a tile with the other words it crosses, in the text where it is shorter."""
    (d, i, _), (e, j, n) = chain[0], chain[-1]
    return min(e - d, j - i) + n


def tiles(doc: np.ndarray, item: np.ndarray, runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Tiles marked greedily: longest first, none overlapping another in doc or item; cut ones are ranked anew."""
    in_doc, in_item, marked = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    heap = [(-span(c), k, c) for k, c in enumerate(chains(doc, item, runs))]
    heapq.heapify(heap)
    serial = len(heap)
    while heap:
        _, _, chain = heapq.heappop(heap)
        if not any(in_doc[d : d + n].any() or in_item[i : i + n].any() for d, i, n in chain):
            for d, i, n in chain:
                in_doc[d : d + n] = in_item[i : i + n] = True
            marked.append(chain)
            continue
        for d, i, n in chain:
            free = ~(in_doc[d : d + n] | in_item[i : i + n])
            edges = np.flatnonzero(np.diff(np.r_[0, free.astype(np.int8), 0])).tolist()
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= SEED:
                    serial += 1
                    heapq.heappush(heap, (a - b, serial, [(d + a, i + a, b - a)]))
    return marked


def judge(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray, least: int, threshold: float | None) -> tuple[float, int] | None:
    """(share of the item covered by tiles, length of the longest tile) if the item has leaked, from all seeds of the pair."""
    marked = tiles(doc, item, matches(d, i))
    longest = max(map(span, marked), default=0)
    covered = sum(n for t in marked for _, _, n in t) / len(item)
    return (covered, longest) if longest >= least or threshold is not None and covered >= threshold else None


def promising(doc: np.ndarray, d: np.ndarray, s: np.ndarray, index: dict) -> np.ndarray:
    """Which seeds lie in twelve tokens of which, on the seed's diagonal or one beside it, enough agree for a tile of twelve.

    A tile of twelve words holds at least ten equal ones around each of its seeds; a word put in or left out moves the rest to
    the diagonal beside, so there the places that agree on either of the three are counted.
    """
    around = np.arange(-(SIGHT // 2), SIGHT)
    padded = np.r_[np.full(SIGHT + 1, -2), doc, np.full(SIGHT + 1, -2)]
    at = (index["start"][index["item"][s]] + index["at"][s])[:, None] + around
    same = np.zeros(at.shape, bool)
    own = index["flat"][at]
    for shift in (0, 1, -1):
        same |= padded[d[:, None] + SIGHT + 1 + around + shift] == own
    seen = np.cumsum(np.c_[np.zeros(len(d), np.int16), same.astype(np.int16)], axis=1, dtype=np.int16)
    return (seen[:, 12:] - seen[:, :-12] >= 9).any(axis=1)


def leaks(doc: np.ndarray, index: dict, threshold: float | None = None) -> list[tuple[int, float, int]]:
    """(place of the item in the index, share of it covered by tiles, longest tile) of every item that leaks into the document."""
    h = rolling(doc)
    lo, hi = np.searchsorted(index["hash"], h), np.searchsorted(index["hash"], h, side="right")
    places = np.flatnonzero(hi > lo)
    if not len(places):
        return []
    n = (hi - lo)[places]
    parts, keep = [], set()
    for part in np.array_split(places, max(1, int(n.sum()) // 50_000)):
        n = (hi - lo)[part]
        d = np.repeat(part, n)
        s = np.repeat(lo[part] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(d))
        keep.update(np.unique(index["item"][s[promising(doc, d, s, index)]]).tolist())
        parts.append((d, s))
    d, s = (np.concatenate(x) for x in zip(*parts))
    owner, at = index["item"][s], index["at"][s]
    if threshold is not None:  # what the seeds cover at most
        pairs = np.unique(owner * (1 << 32) + at)
        who, gap = pairs >> 32, np.r_[SEED, np.minimum(SEED, np.diff(pairs))]
        cover = np.bincount(who, gap, len(index["arrays"]))
        keep.update(k for k in np.unique(who).tolist() if cover[k] >= threshold * len(index["arrays"][k]))
    out = []
    for k in sorted(keep):
        if threshold is None and len(index["arrays"][k]) < index["least"][k]:
            continue
        mine = owner == k
        if (found := judge(doc, index["arrays"][k], d[mine], at[mine], index["least"][k], threshold)) is not None:
            out.append((k, *found))
    return out


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", threshold: float | None = None, block_tokens: int = 400_000) -> DataFrame:
    """(doc_id, item_id, coverage, longest) of every leak.

    `threshold` also counts items of which tiles cover that share, however reordered. Beyond `block_tokens` tokens of items
    (some 50 MB of index) pairs are made by a join; results are the same.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, longest long"
    names = ["doc_id", "item_id", "coverage", "longest"]
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    stock = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    if (stock.agg(F.sum(F.length("text") / 3 + 1)).first()[0] or 0) > block_tokens:
        return _by_join(src, stock, threshold, schema)
    sent = spark.sparkContext.broadcast(build_index([tuple(r) for r in stock.collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, tokens = sent.value, tokenizer()
        vocab = index["vocab"]
        for b in batches:
            rows = []
            for key, t in zip(b["doc_id"], b["text"]):
                ids = np.array([vocab.get(x, 0) for x in tokens(t)], dtype=np.int64)
                rows += [(key, index["ids"][k], c, n) for k, c, n in leaks(ids, index, threshold)]
            yield pd.DataFrame(rows, columns=names)

    return src.mapInPandas(run, schema)


def _hashed():
    """text -> 64-bit hashes of its tokens; made in the worker."""
    import xxhash

    tokens, memo = tokenizer(), {}

    def run(text: str) -> np.ndarray:
        ts = tokens(text)
        if len(memo) > 500_000:
            memo.clear()
        for t in ts:
            if t not in memo:
                memo[t] = xxhash.xxh64_intdigest(t) >> 1
        return np.array([memo[t] for t in ts], dtype=np.int64)

    return run


def seed_table(texts: DataFrame, key: str, passes: np.ndarray | None = None) -> DataFrame:
    """(key, h): the distinct seeds of each text; with `passes`, a bit filter, only those that may be an item's."""
    sent = texts.sparkSession.sparkContext.broadcast(passes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed, bits = _hashed(), sent.value
        for b in batches:
            keys, out = [], []
            for k, t in zip(b[key], b["text"]):
                h = np.unique(rolling(hashed(t)).view(np.int64))
                if bits is not None:
                    at = h.view(np.uint64) % np.uint64(len(bits) * 64)
                    h = h[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                keys += [k] * len(h)
                out.append(h)
            if keys:
                yield pd.DataFrame({key: keys, "h": np.concatenate(out)})

    return texts.mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, h long")


def _by_join(docs: DataFrame, items: DataFrame, threshold: float | None, schema: str, words: int = 1 << 19) -> DataFrame:
    """Leaks for items of any number. The filter has `words` times 64 bits (4 MB), made by the executors; it only thins the join."""
    seeds = seed_table(items, "item_id")
    at = F.pmod("h", F.lit(words * 64))
    # The unsigned remainder, as numpy takes it.
    at = F.pmod(F.when(F.col("h") < 0, at + F.lit((1 << 64) % (words * 64))).otherwise(at), F.lit(words * 64))
    table = np.zeros(words, np.uint64)
    for w, bits in seeds.select(F.shiftright(at, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        table[w] = np.int64(bits).view(np.uint64)
    pairs = seed_table(docs, "doc_id", table).join(seeds, "h").select("doc_id", "item_id").distinct()
    wide = pairs.join(docs.withColumnRenamed("text", "doc"), "doc_id").join(items.withColumnRenamed("text", "item"), "item_id").select("doc_id", "item_id", "doc", "item")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed, tokens = _hashed(), tokenizer()
        for b in batches:
            rows = []
            for d, i, doc, item in zip(b["doc_id"], b["item_id"], b["doc"], b["item"]):
                x, y, least = hashed(doc), hashed(item), least_tokens(tokens(item))
                if threshold is None and len(y) < least:
                    continue
                hx, hy = rolling(x), rolling(y)
                order = np.argsort(hy, kind="stable")
                lo, hi = np.searchsorted(hy[order], hx), np.searchsorted(hy[order], hx, side="right")
                n = hi - lo
                at = np.repeat(np.arange(len(hx)), n)
                s = order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(at))]
                if len(at) and (found := judge(x, y, at, s, least, threshold)) is not None:
                    rows.append((d, i, *found))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage", "longest"])

    return wide.mapInPandas(run, schema)
