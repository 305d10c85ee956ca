"""Benchmark decontamination by greedy string tiling."""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._shared import ALNUM, doc_words, ragged, shingles, slices, small_batches

#: Words of the shortest tile, the share of an item's words that tiles must cover, and words of a tile that suffices alone.
LEAST_TILE, COVERAGE, LONG_TILE = 5, 0.5, 13
#: Benchmark characters in one broadcast index; a larger benchmark goes in several blocks, each over all documents.
BLOCK_CHARS = 32_000_000


def tile(matches: list[tuple[int, int, int]], doc_words: int, item_words: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (position in doc, in item, length), longest first.

    ``matches`` are all maximal matches of ``least`` words or more, in the same form. They wait in a heap; the longest one
    without a marked word becomes a tile and marks its words, one partly marked goes back as its free rests. Ties go to the
    earlier place in the document, then in the item. It ends when no more words of the item are free than a tile needs.
    """
    heap, seen = [(-n, i, j) for i, j, n in matches], set()
    heapq.heapify(heap)
    used_doc, used_item, free_words, out = np.zeros(doc_words, bool), np.zeros(item_words, bool), item_words, []
    while heap and free_words >= least:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = ~(used_doc[i:i + n] | used_item[j:j + n])
        if free.all():
            used_doc[i:i + n] = used_item[j:j + n] = True
            free_words -= n
            out.append((i, j, n))
            continue
        edge = np.diff(np.concatenate([[0], free.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a >= least and (i + a, j + a, b - a) not in seen:
                seen.add((i + a, j + a, b - a))
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


#: Stands for the word before the first one of an item, which no document has.
_NONE = (1 << 32) - 1


class Index:
    """Rolling hashes of all windows of the items, sorted by hash and by the word before, with (item, place)."""

    def __init__(self, ids: list, texts: list[str | None], least: int):
        self.ids, self.least = ids, least
        self.at, self.words = doc_words(texts, ALNUM)
        self.vocabulary, numbers = np.unique(self.words, return_inverse=True)
        n = np.diff(self.at)
        #: window lengths: the shortest tile, and whole items that are shorter
        self.tables = {}
        for k in sorted({min(int(x), least) for x in n if x}):
            item, h = shingles(self.at, self.words, k)
            place = np.arange(len(h)) - np.searchsorted(item, item)
            keep = n[item] >= least if k == least else n[item] == k
            item, h, place = item[keep], h[keep], place[keep]
            different, group = np.unique(h, return_inverse=True)
            before = np.where(place > 0, numbers[np.maximum(self.at[item] + place - 1, 0)], _NONE)
            key = (group.astype(np.int64) << 32) | before
            order = np.argsort(key, kind="stable")
            self.tables[k] = (different, key[order], item[order], place[order])

    def matches(self, at: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(document, item, window, rows (place in document, in item, words)) of all maximal matches.

        A window leads on only where the words before differ, so texts that repeat themselves give as many rows as they
        have matches that cannot be made longer to the left.
        """
        length = np.diff(at)
        for k, (different, key, item, place) in self.tables.items():
            doc, g = shingles(at, words, k)
            mine = np.arange(len(g)) - np.searchsorted(doc, doc)
            group = np.searchsorted(different, g)
            found = np.flatnonzero((group < len(different)) & (different[np.minimum(group, len(different) - 1)] == g) & (length[doc] >= k))
            if not len(found):
                continue
            base = group[found].astype(np.int64) << 32
            word = words[np.maximum(at[doc[found]] + mine[found] - 1, 0)]
            number = np.searchsorted(self.vocabulary, word)
            known = (mine[found] > 0) & (number < len(self.vocabulary)) & (self.vocabulary[np.minimum(number, len(self.vocabulary) - 1)] == word)
            same = base | np.where(known, number, _NONE - 1)
            lo, hi = np.searchsorted(key, base), np.searchsorted(key, base + _NONE, side="right")
            cut, on = np.searchsorted(key, same), np.searchsorted(key, same, side="right")
            rows = np.concatenate([np.repeat(found, cut - lo), np.repeat(found, hi - on)])
            to = np.concatenate([ragged(lo, cut - lo), ragged(on, hi - on)])
            d, q, i, j = doc[rows], item[to], mine[rows], place[to]
            n, x, y = np.full(len(d), k), at[d] + i, self.at[q] + j
            live = np.arange(len(d))
            while len(live):  # all matches grow together
                p, r = x[live] + n[live], y[live] + n[live]
                fits = (p < at[d[live] + 1]) & (r < self.at[q[live] + 1])
                live, p, r = live[fits], p[fits], r[fits]
                live = live[words[p] == self.words[r]]
                n[live] += 1
            order = np.lexsort((j, i, q, d))
            d, q, triples = d[order], q[order], np.stack([i[order], j[order], n[order]], axis=1)
            edge = np.flatnonzero((np.diff(d) != 0) | (np.diff(q) != 0)) + 1
            for a, b in zip([0, *edge], [*edge, len(d)], strict=True):
                if b > a:
                    yield int(d[a]), int(q[a]), k, triples[a:b]

    def hits(self, texts: list[str | None], coverage: float, long: int) -> list[tuple[int, int, float, int, int]]:
        """(text, item, share, covered words, tiles) of the texts that hold an item."""
        at, words = doc_words(texts, ALNUM)
        found = []
        for d, q, k, rows in self.matches(at, words):
            total = int(self.at[q + 1] - self.at[q])
            if rows[:, 2].sum() < min(coverage * total, long):
                continue  # tiles cover no more than the matches do
            tiles = tile(rows.tolist(), int(at[d + 1] - at[d]), total, k)
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * total or tiles[0][2] >= long:
                found.append((d, q, covered / total, covered, len(tiles)))
        return found


def _indexes(spark: SparkSession, benchmark: DataFrame, least: int, block_chars: int) -> Iterator[Broadcast]:
    """The benchmark as broadcast indexes of a bounded size."""
    small_batches(spark)
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    for block in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], least))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS, long: int = LONG_TILE) -> DataFrame:
    """(doc_id, item_id, coverage, covered_words, tiles) of every document that holds an item's words in tiles of ``least``
    words or more which cover the share ``coverage`` of the item, in whatever order, or in one tile of ``long`` words.

    Words are lower-cased runs of letters and digits. Items shorter than a tile must occur whole. Null or empty texts and
    items without words match nothing; repeated rows give a row each; other columns do not matter. Documents stay where
    they are: the benchmark is counted first and goes out in blocks of a bounded size. Texts may be long and may repeat
    themselves: only matches that cannot be made longer to the left are held.
    """
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, coverage double, covered_words int, tiles int"
    out = None
    for shared in _indexes(docs.sparkSession, benchmark, least, block_chars):

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in slices(texts):
                    if found := index.hits(texts[a:b], coverage, long):
                        d, q, share, covered, n = zip(*found, strict=True)
                        yield pa.record_batch([batch.column(0).slice(a, b - a).take(pa.array(d)), pa.array([index.ids[x] for x in q]), pa.array(share), pa.array(covered, pa.int32()), pa.array(n, pa.int32())],
                                              names=["doc_id", "item_id", "coverage", "covered_words", "tiles"])

        part = docs.select("doc_id", "text").mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS, long: int = LONG_TILE) -> DataFrame:
    """The rows of ``docs`` that ``contaminated`` would not report, with all their columns. Each row is judged by its text
    alone and where it stands: nothing is joined or shuffled."""
    place = docs.columns.index("text")
    for shared in _indexes(docs.sparkSession, benchmark, least, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts, stays = batch.column(place).to_pylist(), np.ones(batch.num_rows, bool)
                for a, b in slices(texts):
                    stays[[a + x[0] for x in index.hits(texts[a:b], coverage, long)]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
