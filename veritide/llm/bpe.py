"""Byte-level BPE over whole texts in batched numpy merge rounds.

The distinct words of a batch lie in one flat array of symbols. Each round looks every neighbouring pair up in the sorted
pair keys (binary search), finds each word's lowest rank, and merges all its places of that pair at once; words without a
mergeable pair leave the array. Token ids are put together per text from its words.

Defined results: null, empty texts give []; blanks are ordinary text; the names of special tokens are ordinary text;
repeated rows and ids stay repeated; a word of any length is one word (no cut); lone surrogates can't occur in Spark strings.
"""
import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the vocabulary (words with a leading blank, numbers, marks, runs of white space).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of each byte, sorted pair keys, id made by each pair). A token's pair is what its bytes merge to below its rank."""
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    keys, made = [], []
    width = max(ranks.values()) + 1
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], width), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            keys.append(ranks[parts[0]] * width + ranks[parts[1]])
            made.append(rank)
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return byte_ids, np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order]


def merge_words(words: list[bytes], byte_ids: np.ndarray, keys: np.ndarray, made: np.ndarray) -> list[np.ndarray]:
    """Token ids of each word, by merge rounds over all words at once."""
    none, width = np.iinfo(np.int64).max, int(made.max()) + 1
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    sym = byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    out: list = [np.empty(0, np.int64)] * len(words)
    while len(sym):
        rank = np.full(len(sym), none)
        if len(sym) > 1:
            pair = sym[:-1] * width + sym[1:]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            hit = (keys[at] == pair) & (word[:-1] == word[1:])
            rank[:-1][hit] = made[at[hit]]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(sym)])
        low = np.minimum.reduceat(rank, starts)
        if (low == none).any():  # these words are done
            for k in np.flatnonzero(low == none):
                out[word[starts[k]]] = sym[starts[k] : starts[k] + sizes[k]]
            keep = np.repeat(low != none, sizes)
            sym, word, rank, low, sizes = sym[keep], word[keep], rank[keep], low[low != none], sizes[low != none]
            if not len(sym):
                break
        merge = (rank == np.repeat(low, sizes)) & (rank != none)
        # Of places in a row (aaa: pair at 0 and 1) every second merges, from the left.
        place = np.flatnonzero(merge)
        head = np.r_[True, (np.diff(place) != 1)]
        run = place - place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
        place = place[run % 2 == 0]
        sym[place] = rank[place]
        gone = np.ones(len(sym), dtype=bool)
        gone[place + 1] = False
        sym, word = sym[gone], word[gone]
    return out


def encode(df: DataFrame, text: str, out: str = "ids", vocabulary: str = DEFAULT_VOCABULARY, memory: int = 200_000) -> DataFrame:
    """Adds `out`, the token ids of `text`. The pair table (some 50,000 entries, of fixed size) is sent to the workers; no shuffle.

    `memory` is the number of words whose ids a worker keeps between batches; it only saves work.
    """
    tables = df.sparkSession.sparkContext.broadcast(merge_tables(load_ranks(vocabulary)))
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, known = regex.compile(SPLIT), {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            per_text = [split.findall(t) if t else [] for t in texts]
            fresh = list({w for ws in per_text for w in ws if w not in known})
            for i in range(0, len(fresh), 50_000):
                part = fresh[i : i + 50_000]
                known.update(zip(part, merge_words([w.encode() for w in part], *tables.value)))
            ids = [np.concatenate([known[w] for w in ws]).astype(np.int32) if ws else np.empty(0, np.int32) for ws in per_text]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [column], names=[*names, out])
            if len(known) > memory:
                known.clear()

    from pyspark.sql import types as T

    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)
