"""Near-duplicates by DartMinHash.

Every word shingle throws darts into its weight region: a Poisson process over (weight, rank) whose points depend on the
shingle alone. A dart names a coordinate; the earliest dart of each coordinate is the signature. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. A document throws about k ln k + 2k darts however
long it is, on top of one look at each shingle.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._shared import SPACED, U, discard, doc_words, folders, mix, settle, shingles, slices, work_dir
from tracewright.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: 24 bands of 5: two texts of similarity 0.8 miss each other with probability 1e-4, of 0.9 with 1e-9.
BANDS, ROWS = 24, 5
#: Rounds with one centre for each band, before the prefix filter settles the bands that are still open.
_TURNS = 3
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """Signatures (docs, k) of weighted sets given as (document, element hash, weight) entries, one for each element of a set.

    High 32 bits: the dart's rank as a float; low: its hash. A document without weight keeps the empty mark. If a
    coordinate is still empty, the document's rank limit doubles until none is.
    """
    total = np.bincount(doc, weights=weight, minlength=docs)
    sig = np.full((docs, k), _EMPTY, dtype=U)
    limit = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(docs), where=total > 0)
    todo = total > 0
    while todo.any():
        pick = todo[doc]
        _throw(sig, doc[pick], element[pick], weight[pick], limit, k)
        todo = todo & (sig == _EMPTY).any(axis=1)
        limit = limit * 2
    return sig


def _throw(sig: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int) -> None:
    cells = np.ceil(weight).astype(np.int64)  # the weight axis in cells of width 1; the last may be cut
    rep = np.repeat(np.arange(len(doc)), cells)
    cell = np.arange(len(rep)) - np.repeat(np.cumsum(cells) - cells, cells)
    doc, room = doc[rep], weight[rep] - cell
    seed, flat = mix(element[rep] + mix(cell.astype(U) + U(0x51ED2701))), sig.reshape(-1)
    rank, most, i = np.zeros(len(doc)), limit[doc], 0
    while len(doc):
        i += 1
        h = mix(seed + U(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rank = rank - np.log(((h >> U(11)).astype(np.float64) + 1) * 2.0**-53)
        live = rank <= most
        doc, seed, rank, most, room, h = doc[live], seed[live], rank[live], most[live], room[live], h[live]
        dart = mix(h ^ U(0x2545F4914F6CDD1D))
        inside = (mix(dart + U(77)) >> U(11)).astype(np.float64) * 2.0**-53 < room
        value = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (dart & U(0xFFFFFFFF))
        at = doc * k + ((dart >> U(32)) % U(k)).astype(np.int64)
        np.minimum.at(flat, at[inside], value[inside])


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    s = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * U(0xD6E8FEB86659FD93)), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key ^ (s[:, :, r] + U(r + 1)))
    return key


def shingle_table(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, two hashes of the raw text, shingle count, band keys and the set of 32-bit shingle hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in slices(texts):
                n = b - a
                doc, h = shingles(*doc_words(texts[a:b], SPACED), words)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[first], h[first]
                sig = dart_signatures(doc, h, np.ones(len(h)), n, bands * rows)
                count = np.bincount(doc, minlength=n)
                keys = band_keys(sig, bands, rows).view(np.int64)
                has = count > 0
                ends = np.append(0, np.cumsum(has * bands)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[has].reshape(-1)))
                sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array((h >> U(32)).astype(np.uint32).view(np.int32)))
                yield pa.record_batch([*batch.slice(a, n).columns[:3], pa.array(count.astype(np.int32)), lists, sets], names=["doc_id", "h1", "h2", "n", "bands", "sh"])

    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"), text.alias("text"))
    return base.mapInArrow(sign, f"doc_id {kind}, h1 long, h2 long, n int, bands array<long>, sh array<int>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have the Jaccard similarity or more."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("_x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(x, "a").join(y, "b").filter(both >= similarity * (F.size("_x") + F.size("_y") - both) - 1e-9).select("a", "b")


def _prefix_pairs(docs: DataFrame, sets: DataFrame, similarity: float, path: str) -> DataFrame:
    """Pairs of documents of different components that may reach the similarity, by prefix filtering, which is exact.

    With the shingles of all sets in one order, rare ones first, two sets of Jaccard similarity t or more share one of the
    first n - ceil(t n) + 1 of either, and their first common one must leave room for the rest on both sides. Texts that have just a common passage in common do not meet in their rare shingles.
    """
    held = settle(docs.join(sets, "doc_id").select("doc_id", "n", "root", F.explode("sh").alias("t")), f"{path}/held")
    often = settle(held.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1"), f"{path}/often")
    # a shingle of one set alone is the rarest there is: it takes a place of the prefix and leads to no pair
    per = held.join(often, "t").groupBy("doc_id", "n", "root").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts"))
    # left: shingles of the set from this one on, itself included
    alone = F.col("n") - F.size("ts")
    places = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - alone
    listed = per.filter(places > 0).select("doc_id", "n", "root", F.posexplode(F.slice("ts", F.lit(1), places.cast("int"))).alias("at", "x"), alone.alias("_alone"))
    first = settle(listed.select("doc_id", "n", "root", F.col("x.t").alias("t"), (F.col("n") - F.col("_alone") - F.col("at")).alias("left")), f"{path}/first")
    # a pair's first common shingle has all their common ones behind it on either side; the smaller set needs a longer rest
    rest = lambda left, n, m: left * (1 + similarity) >= similarity * (n + m) - 1e-9
    small = first.filter(rest(F.col("left"), F.col("n"), F.col("n")))
    large = first.select(F.col("doc_id").alias("b"), F.col("n").alias("_n"), F.col("root").alias("_r"), "t", F.col("left").alias("_left"))
    ordered = (F.col("_n") > F.col("n")) | ((F.col("_n") == F.col("n")) & (F.col("b") > F.col("doc_id")))
    met = small.join(large, "t").filter((F.col("root") != F.col("_r")) & ordered & rest(F.least("left", "_left"), F.col("n"), F.col("_n")))
    return met.select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) for every row: class_id is the smallest doc_id of the class.

    Classes are the components of links between texts: equal raw texts, or candidates of a shared band with shingle sets
    of the similarity or more. Texts of under five words are one shingle of all their words; texts without words (null is
    empty) are equal to their exact copies only. Rows of one doc_id count as one document; a null doc_id is a class of
    its own, with a null class_id. An empty table gives no rows.

    Copies meet in a partial minimum, never as pairs. A band's documents are compared with one centre, so a large group
    of near copies costs a comparison for each. Where that leaves a band with several components two more centres follow,
    and then the documents of those bands meet by an exact prefix filter, so no candidate is lost. The rounds are the same
    at any size.
    """
    spark = docs.sparkSession
    with folders() as made:
        classes = _classes(docs.filter("doc_id IS NOT NULL"), words, similarity, bands, rows)
        done = list(made)
        classes = settle(classes, f"{work_dir(spark, 'classes')}/rows")
    discard(spark, done)
    return classes.unionByName(docs.filter("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id")))


def _classes(known: DataFrame, words: int, similarity: float, bands: int, rows: int) -> DataFrame:
    root = work_dir(known.sparkSession, "neardup")
    table = settle(shingle_table(known, words, bands, rows), f"{root}/shingles")
    reps = settle(table.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), f"{root}/reps")
    one = table.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    banded = one.select("doc_id", "n", F.explode("bands").alias("band")).distinct()
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band")
    members = settle(banded.join(shared, "band"), f"{root}/members")
    ids = members.select("doc_id").distinct()
    sets = settle(one.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("sh").alias("sh")), f"{root}/sets")

    links = roots = None
    size = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y)
    for turn in range(_TURNS + 1):
        at = members.withColumn("root", F.col("doc_id")) if roots is None else members.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        if turn:
            at = settle(at.join(live.select("band"), "band", "left_semi"), f"{root}/at{turn}")
        # a band is live while it holds several components
        held = at.groupBy("band", "root").agg(F.count("*").alias("k"))
        live = settle(held.groupBy("band").agg(F.count("*").alias("roots")).filter("roots > 1").select("band"), f"{root}/live{turn}")
        if live.isEmpty():
            break
        last = turn == _TURNS
        if last:
            pairs = _prefix_pairs(at.select("doc_id", "n", "root").distinct(), sets, similarity, f"{root}/prefix")
        else:
            first = F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("doc_id")
            centre = at.groupBy("band").agg(F.min_by(F.struct("doc_id", "n", "root"), first).alias("centre"))
            pairs = (at.join(settle(centre.join(live.select("band"), "band"), f"{root}/centre{turn}"), "band")
                     .filter((F.col("doc_id") != F.col("centre.doc_id")) & (F.col("root") != F.col("centre.root")) & size(F.col("n"), F.col("centre.n")))
                     .select(F.col("centre.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct())
        new = settle(_verified(pairs, sets, similarity), f"{root}/links{turn}")
        links = new if links is None else links.unionByName(new)
        roots = settle(components(links), f"{root}/roots{turn}")
        if last:
            break
    rep = table.select("doc_id", "h1", "h2").join(reps, ["h1", "h2"]).select("doc_id", "rep")
    if roots is not None:
        rep = rep.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    else:
        rep = rep.withColumnRenamed("rep", "class_id")
    return rep
