"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set is its distinct five-word shingles. Its sketch has ``BINS`` coordinates filled in rounds: in round
i < BINS every shingle is thrown into the bin that hash i names, in round BINS + j all go to bin j; a coordinate
keeps the least (round, hash). The second half guarantees that every coordinate fills; sets of a few hundred
shingles are done after two or three rounds, unlike one pass for each coordinate. Two sketches agree in a coordinate
with probability J, with concentration as for independent hash functions.

Equal sets fold into classes first, so copies cost nothing further. Bands of ``ROWS`` coordinates make candidates. In
a bucket each class is compared with the bucket's least class (a star, never all pairs) on full sets; links join
classes into components. Then the classes of a bucket that are *still in different components* are searched too, by an exact prefix
filter and exact intersections of their full sets: pairs already connected need no link, all others that can be
similar are verified, so no bucket is capped and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.closure import connected_components
from . import common as C

#: Words in a shingle, coordinates of a sketch, coordinates in a band; similarity 3/4 exactly.
WORDS, BINS, ROWS = 5, 128, 4
BANDS = BINS // ROWS
#: Classes in a chunk of a family, shingles in a slab of an incidence matrix: the bounds of a task's memory.
CHUNK, SLAB = 256, 8_192
_SEEDS = C.mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[bytes]):
    """Sorted distinct 64-bit shingle hashes of each text; fewer than five words make one shingle, none none."""
    for ids, buf, bounds in C.gather(texts):
        h, first, _ = C.words_of(buf, bounds)
        runs = C.tuple_hash(h, WORDS) if len(h) >= WORDS else None
        for k in range(len(ids)):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= WORDS:
                yield np.unique(runs[a : b - WORDS + 1])
            elif b > a:
                yield C.mix(C.tuple_hash(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield h[:0]


def sketch(items: np.ndarray) -> np.ndarray:
    """The sketch's coordinates: round in the top bits, hash below."""
    out = np.full(BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(2 * BINS):
        h = C.mix(items ^ _SEEDS[i])
        value = np.uint64(i) << np.uint64(48) | h >> np.uint64(16)
        if i < BINS:
            np.minimum.at(out, (h & np.uint64(BINS - 1)).astype(np.int64), value)
        else:
            out[i - BINS] = min(out[i - BINS], value.min())
        if (out != np.uint64(0xFFFFFFFFFFFFFFFF)).all():
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    own = coordinates.reshape(BANDS, ROWS)
    out = _SEEDS[:BANDS].copy()
    for c in range(ROWS):
        out = C.mix(out * np.uint64(3) + own[:, c])
    return out


def _describe(batches):
    """doc_id, size of the set, its digest (of empty sets the document's own), its band keys."""
    for pdf in batches:
        rows = []
        for doc, none, items in zip(pdf["doc_id"], pdf["no_id"], shingle_sets([C.as_bytes(t) for t in pdf["text"]])):
            if len(items):
                digest = f"{len(items)}-{int(C.mix(items).sum()):x}-{int(C.mix(items ^ _SEEDS[0]).sum()):x}"
                rows.append((doc, none, len(items), digest, band_keys(sketch(items)).view(np.int64)))
            else:
                rows.append((doc, none, 0, f"-{doc}", []))
        yield pd.DataFrame(rows, columns=["doc_id", "no_id", "n", "digest", "keys"])


def _sets(batches):
    for pdf in batches:
        rows = [(c, items.view(np.int64)) for c, items in zip(pdf["class"], shingle_sets([C.as_bytes(t) for t in pdf["text"]]))]
        yield pd.DataFrame(rows, columns=["class", "items"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Null, empty and blank texts have the empty
    set and link with nothing, also not with each other. Rows that share a doc_id are one document for linking: all
    that either links to is one component. Null doc_ids come back with a null component and kept true. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = C.keyed(docs, "text").mapInPandas(_describe, "doc_id long, no_id boolean, n long, digest string, keys array<long>")
    described = C.cut(described.select(C.doc_id(), "n", "digest", "keys"), "near-sets")
    named = described.where("doc_id is not null and n > 0")
    # Equal sets are one class, known by its least doc_id; only that row takes part in the search.
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("class"))
    heads = named.join(classes.select(F.col("class").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    keyed = heads.select(F.col("doc_id").alias("class"), F.explode("keys").alias("key"))
    # Buckets of one class make no candidate.
    full = keyed.groupBy("key").agg(F.min("class").alias("center"), F.max("class").alias("top")).where("center < top").drop("top")
    members = C.cut(keyed.join(full, "key").distinct(), "near-buckets")
    wanted = members.select(F.col("class").alias("doc_id")).distinct()
    sets = C.cut(rows.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("class"), "text").mapInPandas(_sets, "class long, items array<long>"), "near-full-sets")

    star = members.where("class <> center").select(F.col("center").alias("a"), F.col("class").alias("b")).distinct()
    links = C.cut(_verified(star, sets).unionByName(_same_id_links(named, classes)), "near-links")
    more = C.cut(_across(members, connected_components(links), sets), "near-more-links")
    every = connected_components(links.unionByName(more))

    out = described.drop("keys").join(classes, "digest", "left").join(every.select(F.col("id").alias("class"), "component"), "class", "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    component = F.when(linked, F.coalesce("component", "class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _across(members: DataFrame, placed: DataFrame, sets: DataFrame) -> DataFrame:
    """All links between classes that share a bucket but are in different components, found without listing pairs.

    Shingles are ordered by the number of classes that hold them, those of one component only first. Two sets with
    J >= 3/4 share a shingle among the first n - ceil(3n/4) + 1 of each (the prefix filter), and as the two are in
    different components it is one that crosses components; a passage that thousands of documents share comes last
    in that order. Classes that such shingles connect are a family. A family's sets are dealt into chunks by size
    (sizes of J >= 3/4 differ by a factor of 4/3 at most, so only neighbouring size groups meet), and any two chunks
    meet in a task of bounded size, which counts all intersections by products of incidence matrices and puts out
    links only: families of many almost-similar texts cost arithmetic, not rows.
    """
    own = members.join(placed.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    split = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    loose = C.cut(own.join(split, "key").select("class", "component").distinct(), "near-loose")
    items = sets.join(loose, "class").select("class", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
    held = items.groupBy("item").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("item", "df")
    crossing = items.join(held, "item")
    by = Window.partitionBy("class", "n").orderBy("df", "item")
    prefix = F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1
    ranked = crossing.withColumn("place", F.row_number().over(by)).withColumn("shared", F.count("*").over(Window.partitionBy("class", "n")))
    heads = C.cut(ranked.where(F.col("n") - F.col("shared") + F.col("place") <= prefix).select("class", "item"), "near-prefixes")
    least = heads.groupBy("item").agg(F.min("class").alias("a"))
    family = C.cut(connected_components(heads.join(least, "item").select("a", F.col("class").alias("b"))), "near-families").select(F.col("id").alias("class"), F.col("component").alias("family"))
    placed_sets = sets.join(loose, "class")
    # Size groups grow by 4/3 each; the least power is taken from whole numbers, as n may lie on a border.
    borders = [1]
    while borders[-1] < 1 << 40:
        borders.append(-(-borders[-1] * 4 // 3))
    sized = family.join(placed_sets.select("class", F.size("items").alias("n")), "class").withColumn("grp", F.expr(f"aggregate(array({', '.join(f'{b}L' for b in borders)}), 0, (k, b) -> k + int(n >= b))"))
    chunks = sized.groupBy("family", "grp").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = sized.join(chunks, ["family", "grp"]).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    # Every chunk meets those of its own group and of the next one.
    own = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own = own.select("class", "family", "chunk", F.col("grp").alias("g"), F.col("grp").alias("h"), F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), (F.col("chunk") <= F.col("other")).alias("left"))
    up, down = chunks.select("family", (F.col("grp") - 1).alias("grp"), F.col("chunks").alias("beyond")), chunks.select("family", (F.col("grp") + 1).alias("grp"), F.col("chunks").alias("beyond"))
    over = lambda side: dealt.join(side, ["family", "grp"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("beyond") - 1)))
    upper = over(up).select("class", "family", "chunk", F.col("grp").alias("g"), (F.col("grp") + 1).alias("h"), F.col("chunk").alias("lo"), F.col("other").alias("hi"), F.lit(True).alias("left"))
    lower = over(down).select("class", "family", "chunk", (F.col("grp") - 1).alias("g"), F.col("grp").alias("h"), F.col("other").alias("lo"), F.col("chunk").alias("hi"), F.lit(False).alias("left"))
    meets = own.unionByName(upper).unionByName(lower)
    return meets.join(placed_sets, "class").groupBy("family", "g", "h", "lo", "hi").applyInPandas(_linked_chunks, "a long, b long")


def _linked_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between two chunks of a family (or within one), in different components."""
    one = pdf["g"].iloc[0] == pdf["h"].iloc[0] and pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
    pdf = pdf.sort_values("class", kind="stable")
    left = pdf[pdf["left"]]
    right = left if one else pdf[~pdf["left"]]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    x, y = list(left["items"]), list(right["items"])
    nx, ny = np.array(list(map(len, x))), np.array(list(map(len, y)))
    vocabulary, count = np.unique(np.concatenate(x + ([] if one else y)), return_counts=True)
    vocabulary = vocabulary[count > 1]
    common = np.zeros((len(x), len(y)), np.float32)
    for s in range(0, len(vocabulary), SLAB):
        slab = vocabulary[s : s + SLAB]
        a = _incidence(x, slab)
        common += a @ (a if one else _incidence(y, slab)).T
    near = 100 * common >= 75 * (nx[:, None] + ny[None, :] - common)
    p, q = left["component"].to_numpy(), right["component"].to_numpy()
    near &= p[:, None] != q[None, :]
    i, j = np.nonzero(near)
    # One link connects two components as well as all: keep the first of each pair of components.
    joined = np.stack([np.minimum(p[i], q[j]), np.maximum(p[i], q[j])], 1)
    _, first = np.unique(joined, axis=0, return_index=True)
    i, j = i[first], j[first]
    a, b = left["class"].to_numpy()[i], right["class"].to_numpy()[j]
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = top.get(top[x], top[x])
            x = top[x]
        return x

    rows = []
    for x, y, u, v in zip(p[i].tolist(), q[j].tolist(), a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            top[x] = y
            rows.append((min(u, v), max(u, v)))
    return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")


def _incidence(sets: list[np.ndarray], slab: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(slab)), np.float32)
    for i, items in enumerate(sets):
        at = np.minimum(np.searchsorted(slab, items), len(slab) - 1)
        out[i, at[slab[at] == items]] = 1
    return out


def _same_id_links(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows that share a doc_id but not a set link their classes."""
    several = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id")
    of = named.join(several, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "class")
    return of.groupBy("doc_id").agg(F.min("class").alias("a"), F.collect_set("class").alias("own")).select("a", F.explode("own").alias("b")).where("a <> b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= 75 * union."""
    left, right = sets.select(F.col("class").alias("a"), F.col("items").alias("p")), sets.select(F.col("class").alias("b"), F.col("items").alias("q"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("p", "q")))
    return both.where("100 * common >= 75 * (size(p) + size(q) - common)").select("a", "b").distinct()


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over all of ``documents``."""
    return near_duplicates(C.table(spark, sf_dir, "documents"))


#: All shingles joined on equality, intersections counted, links closed.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS items FROM w),
s AS (SELECT doc_id, unnest(items) AS item FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.items) + len(y.items) - n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.other = edges.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(items) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON least.id = sets.doc_id
"""
