"""Benchmark decontamination: documents with a passage within a few word edits of a benchmark item.

Item-sized word windows of the documents are embedded by random walks (CGK): at each step the walk emits the word that it
stands at and, by a random bit of that word and step, moves on or stays. Two windows that few edits apart take walks that
meet again soon, so their embeddings differ in few places, and sampling places of them hashes them to the same bucket
often. Enough repetitions reach the wanted recall; whatever meets an item in a bucket is then held against the exact
edit distance of the item to the best passage there.

Only windows that can match are embedded: of an item cut into one more piece than the edits allowed, every matching
passage holds a piece unchanged, so windows are set where a piece of an item occurs. That loses nothing. A window is one of
a place and a length, however many items would set it there: which of them it may match, the buckets tell, and of those only
the ones go on to the edit distance whose words the passage holds, but for the edits allowed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bound_batches, fresh_name, saved

TRIM = b".,;:!?\"'()[]*#%&$|<>"


@dataclass(frozen=True)
class DecontamParams:
    #: An item matches a passage within this share of its words in edits, rounded down.
    edits: float = 0.2
    #: Hash repetitions, and places of the embedding sampled in each.
    repetitions: int = 48
    places: int = 2
    seed: int = 7
    #: Items in one pass over the documents; more are searched in blocks of so many, each in a pass of its own, with the
    #: documents and what was found so far written between, so that one block's index is in memory at a time.
    block: int = 20_000


def word_codes(text: str | None) -> np.ndarray:
    """A number for each word: ASCII lower case, without marks around it; words of marks alone are left out."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    distinct = list(dict.fromkeys(words))
    number = dict(zip(distinct, range(len(distinct))))
    bare = [w.strip(TRIM) for w in distinct]
    codes = np.array([xxhash.xxh64_intdigest(w) for w in bare], np.uint64)
    empty = np.array([not w for w in bare], bool)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return codes[ids][~empty[ids]] if len(words) else np.zeros(0, np.uint64)


def rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = codes[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def best_passage(item: np.ndarray, text: np.ndarray) -> int:
    """The least word edit distance of the item to any passage of the text."""
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)  # a passage may begin anywhere
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


class Walks:
    """Random walks over windows of one length; the same for every process, as they follow from the seed."""

    def __init__(self, length: int, params: DecontamParams) -> None:
        rng = np.random.default_rng((params.seed, length))
        self.length, self.steps = length, 2 * length
        self.odd = rng.integers(1 << 62, size=(self.steps, params.repetitions), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        order = np.argsort(rng.random((params.repetitions, self.steps)), axis=1)
        self.places = order[:, : params.places]

    def buckets(self, windows: np.ndarray) -> np.ndarray:
        """windows (n, length) of word codes -> (n, repetitions) bucket hashes."""
        n, reps = len(windows), self.odd.shape[1]
        padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
        stand = np.zeros((n, reps), np.int64)
        out = np.zeros((n, reps), np.uint64)
        row = np.arange(n)[:, None]
        for step in range(self.steps):
            word = padded[row, stand]
            taken = (self.places == step).any(axis=1)
            if taken.any():
                out[:, taken] = out[:, taken] * np.uint64(0x100000001B3) + word[:, taken] + np.uint64(step + 1)
            move = (word + np.uint64(1)) * self.odd[step] >> np.uint64(63)
            stand = np.minimum(stand + move.astype(np.int64), self.length)
        return out


class Index:
    """The distinct items: where windows are set by their pieces, and their buckets by length."""

    def __init__(self, items: list[tuple[int, str]], params: DecontamParams) -> None:
        self.params = params
        ids: dict[bytes, list[int]] = defaultdict(list)
        for i, text in items:
            if len(codes := word_codes(text)):
                ids[codes.tobytes()].append(i)
        self.ids, by_length = list(ids.values()), defaultdict(list)
        self.pieces: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for k, codes in enumerate(np.frombuffer(c, np.uint64) for c in ids):
            by_length[len(codes)].append((k, codes))
            cuts = np.linspace(0, len(codes), self.allowed(len(codes)) + 2).astype(int)
            for a, b in zip(cuts, cuts[1:]):
                self.pieces[int(b - a)][int(rolled(codes[a:b], int(b - a))[0])].add((len(codes), int(a)))
        self.maps = {}
        for width, found in self.pieces.items():
            seen = np.zeros(1 << 20, bool)
            seen[np.array(list(found), np.uint64) >> np.uint64(44)] = True
            self.maps[width] = seen
        self.walks = {length: Walks(length, params) for length in by_length}
        self.words, self.numbers, self.keys, self.holders = {}, {}, {}, {}
        for length, found in by_length.items():
            self.numbers[length], self.words[length] = [k for k, _ in found], np.array([c for _, c in found])
            keys = self._keys(length, self.words[length])
            order = np.argsort(keys, axis=None, kind="stable")
            self.keys[length], self.holders[length] = keys.reshape(-1)[order], order // keys.shape[1]

    def allowed(self, length: int) -> int:
        return int(self.params.edits * length)

    def _keys(self, length: int, windows: np.ndarray) -> np.ndarray:
        """(window, repetition): the bucket, told apart by repetition."""
        return self.walks[length].buckets(windows) ^ (np.arange(self.params.repetitions, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, codes: np.ndarray) -> set[tuple[int, int]]:
        """(length, start) of the windows in which a piece of an item stands where it would in the item."""
        found = set()
        for width, pieces in self.pieces.items():
            hashes = rolled(codes, width)
            for p in np.flatnonzero(self.maps[width][hashes >> np.uint64(44)]):
                found.update((length, int(p) - offset) for length, offset in pieces.get(int(hashes[p]), ()))
        return found

    def search(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text: item id -> least edit distance, of the items that match."""
        coded = [word_codes(t) for t in texts]
        out: list[dict[int, int]] = [{} for _ in texts]
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, codes in enumerate(coded):
            for length, start in sorted(self.windows(codes)):
                by_length[length].append((n, start))
        for length, all_found in by_length.items():
            spare = self.allowed(length)
            for at in range(0, len(all_found), 2048):
                found = all_found[at : at + 2048]
                windows = np.zeros((len(found), length), np.uint64)
                for row, (n, start) in enumerate(found):
                    a, b = max(0, start), min(len(coded[n]), start + length)
                    windows[row, a - start : b - start] = coded[n][a:b]
                keys = self._keys(length, windows)
                low, high = (np.searchsorted(self.keys[length], keys, side) for side in ("left", "right"))
                for row in np.flatnonzero((high > low).any(axis=1)):
                    n, start = found[row]
                    met = np.unique(np.concatenate([self.holders[length][a:b] for a, b in zip(low[row], high[row]) if b > a]))
                    passage = coded[n][max(0, start - spare) : max(0, start + length + spare)]
                    there = np.unique(passage)
                    words = self.words[length][met]
                    held = there[np.minimum(np.searchsorted(there, words), len(there) - 1)] == words if len(there) else np.zeros(words.shape, bool)
                    for k in met[held.sum(axis=1) >= length - spare]:  # a word that isn't there takes an edit
                        item, ids = self.words[length][k], self.ids[self.numbers[length][k]]
                        if out[n].get(ids[0]) == 0:
                            continue
                        distance = 0 if np.array_equal(windows[row], item) else best_passage(item, passage)
                        if distance <= spare:
                            out[n] |= {i: min(distance, out[n].get(i, distance)) for i in ids}
        return out


def _search(items: Broadcast):
    @F.pandas_udf("ids array<long>, distances array<long>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(*items.value)
        for batch in batches:
            found = [sorted(x.items()) for x in index.search(list(batch))]
            yield pd.DataFrame({"ids": [[i for i, _ in x] for x in found], "distances": [[d for _, d in x] for x in found]})

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", params: DecontamParams = DecontamParams()) -> DataFrame:
    """``docs`` with contaminated, kept (its opposite), n_items, item_ids (array, ascending) and least_distance (null if none).

    benchmark: (item_id, text). Items with null ids, and items and texts that are null or have no words, match nothing.
    Items of fewer than five words match when unchanged. Repeated items count once by id; repeated rows of ``docs`` get
    equal results. Columns of ``docs`` with these names give way to the operator's. Empty tables give no matches.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    blocks = max(1, -(-items.count() // params.block))
    own = ["contaminated", "kept", "n_items", "item_ids", "least_distance"]
    held = [fresh_name(docs, f"_found{b}") for b in range(blocks)]
    out = docs
    for b, name in enumerate(held):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # a block at most or little more
        index = spark.sparkContext.broadcast(([(r["item_id"], r["text"]) for r in part], params))
        out = out.withColumn(name, _search(index)(F.col(text_col)))
        if blocks > 1:
            out = saved(out, "decontam-block")
            index.destroy()
    ids = F.array_sort(F.array_distinct(F.concat(*[F.col(h)["ids"] for h in held])))
    distances = F.concat(*[F.col(h)["distances"] for h in held])
    hit = F.size(ids) > 0
    return out.select(
        *[F.col(c) for c in docs.columns if c.lower() not in own],
        hit.alias("contaminated"), (~hit).alias("kept"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_min(distances).alias("least_distance"),
    )
