"""Suffix-array dedup: a common-prefix-aware distributed merge sort over sparse suffixes.

A byte of document d is removed if a 50-byte string that covers it also starts in a document with a smaller id.

1. Every 50-byte window has an *anchor*: the k-gram in it with the least hash. Equal windows have equal anchors
   at equal offsets, so suffixes need to be sorted at anchors only (about one byte in 14).
2. Blocks of documents exchange anchor hashes as packed sorted arrays; those met in one document only cannot
   begin a repeat and are dropped (a superset of the repeats stays, nothing is lost).
3. Each block sorts the remaining anchor suffixes, with the bytes before the anchor behind them, into a *run*,
   folds equal ones (least doc_id stays) and front-codes it: common prefix length and the rest.
4. Runs are cut at sampled splitters, exchanged, and combined by a loser tree that starts each comparison behind
   the prefix already known to be equal. Neighbours in the merged order give each window's least doc_id, which
   goes back to the blocks, where covered bytes are removed.

Copies fold before they are exchanged, so a group of copies of any size costs one entry a block.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Length of a repeat in bytes (the contract's), and of an anchor.
LENGTH, K = 50, 24
#: Offsets at which an anchor can lie in a window.
OFFSETS = LENGTH - K + 1
#: Bytes of a sort key: the suffix, the reversed bytes before it, how many of each are there.
KEY = LENGTH + OFFSETS - 1 + 2
#: Suffixes of a merge part, about, and sampled keys for each part. The driver sees so many keys of ``K`` bytes a part.
PER_PART, PICKS = 100_000, 16
#: Keys of an anchor that are compared two by two; more go offset by offset.
FEW = 8
NONE = np.iinfo(np.int64).max

RUNS = "blk long, n long, run binary, docs binary, pos binary, item binary, sample array<binary>"
ANSWERS = "blk long, solo binary, least binary, mixed binary, leasts binary"
OUTPUT = "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    """f over all windows of w neighbours, by doubling."""
    n, size = len(x) - w + 1, 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[:n], x[w - size : w - size + n])


def anchors(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows that lie within one text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(buf) < LENGTH:
        return none
    prefix = C.prefix_hash(buf)
    h = prefix[K:] - prefix[:-K]
    h *= C.powers(len(h))[1]
    h = C.mix(h)
    least = _sliding(np.minimum, h, OFFSETS)  # by window start
    crosses = np.zeros(len(buf) + 1, np.int32)  # windows that begin fewer than LENGTH bytes before a text's end
    ends = bounds[1:]
    np.add.at(crosses, np.maximum(ends - LENGTH + 1, bounds[:-1]), 1)
    np.add.at(crosses, ends, -1)
    least[np.cumsum(crosses)[: len(least)] > 0] = 0
    pad = np.zeros(OFFSETS - 1, np.uint64)
    most = _sliding(np.maximum, np.concatenate([pad, least, pad]), OFFSETS)  # by gram: most of its windows' least
    at = np.flatnonzero((most == h) & (most != 0))
    return at, h[at]


def _block(pdf: pd.DataFrame):
    """The block's documents in one fixed order: ids (null last), buffer, bounds."""
    ids = np.where(pdf["no_id"].to_numpy(bool), NONE, pdf["doc_id"].to_numpy(np.int64))
    texts = [C.as_bytes(t) for t in pdf["text"]]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order], order


def _anchors_of_block(texts: list[bytes]):
    """Anchors of all texts: position in the concatenated block, hash, number of the text; chunk by chunk."""
    base = 0
    for ids, buf, bounds in C.gather(texts):
        at, h = anchors(buf, bounds)
        yield base, buf, bounds, at, h, np.searchsorted(bounds, at, side="right") - 1 + ids[0]
        base += len(buf)


def _send_hashes(buckets: int):
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, texts, _ = _block(pdf)
        found = [(h, ids[d]) for _, _, _, _, h, d in _anchors_of_block(texts)]
        h = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint64)
        d = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")  # documents stay in order within a hash
        h, d = h[order], d[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(h)] - 1
        many = d[first] != d[last] if len(h) else np.zeros(0, bool)
        h = h[first]
        b = (h >> shift).astype(np.int64) if shift is not None else np.zeros(len(h), np.int64)
        rows = [(int(pdf["blk"].iloc[0]), k, h[i:j].tobytes(), np.packbits(many[i:j]).tobytes()) for k, i, j in C.ranges(b)]
        return pd.DataFrame(rows, columns=["blk", "bucket", "hashes", "many"])

    return send


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one range of hashes: which of each block's hashes occur in two documents at least."""
    own = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
    many = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(h)].astype(bool) for m, h in zip(pdf["many"], own)]
    every = np.sort(np.concatenate(own))
    twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(h[m] for h, m in zip(own, many))]))
    return pd.DataFrame({"blk": pdf["blk"], "hashes": [h[_in(h, twice)].tobytes() for h in own]})


def _in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _keys(buf: np.ndarray, bounds: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Sort keys of the suffixes at ``at``; what lies outside the text is zero."""
    before, after = np.minimum(at - bounds[text], OFFSETS - 1), np.minimum(bounds[text + 1] - at, LENGTH)
    padded = np.concatenate([np.zeros(OFFSETS, np.uint8), buf, np.zeros(LENGTH, np.uint8)])
    out = np.zeros((len(at), KEY), np.uint8)
    right, left = np.arange(LENGTH), np.arange(1, OFFSETS)
    out[:, :LENGTH] = padded[at[:, None] + (OFFSETS + right)]
    out[:, :LENGTH][right >= after[:, None]] = 0
    out[:, LENGTH:-2] = padded[at[:, None] + (OFFSETS - left)]
    out[:, LENGTH:-2][left > before[:, None]] = 0
    out[:, -2], out[:, -1] = after, before
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """Order of equally long byte strings."""
    wide = np.zeros((len(keys), -(-keys.shape[1] // 8) * 8), np.uint8)
    wide[:, : keys.shape[1]] = keys
    return np.lexsort(wide.view(">u8").T[::-1])


def front_code(keys: np.ndarray) -> bytes:
    """A sorted run as common prefix lengths followed by what differs."""
    same = keys[1:] == keys[:-1]
    lcp = np.r_[0, np.where(same.all(1), KEY, same.argmin(1))].astype(np.uint8) if len(keys) else np.zeros(0, np.uint8)
    rest = keys[np.arange(KEY) >= lcp[:, None]]
    return lcp.tobytes() + rest.tobytes()


def front_decode(n: int, blob: bytes) -> tuple[list[int], list[bytes]]:
    """Common prefix lengths and whole keys of a front-coded run of n."""
    lcps, at, key, keys = list(blob[:n]), n, b"", []
    for h in lcps:
        key = key[:h] + blob[at : at + KEY - h]
        at += KEY - h
        keys.append(key)
    return lcps, keys


def _make_run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    if not len(docs) or not len(answers):
        return pd.DataFrame(columns=["blk", "n", "run", "docs", "pos", "item", "sample"])
    ids, texts, _ = _block(docs)
    wanted = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in answers["hashes"]]))
    keys, of, pos = [np.zeros((0, KEY), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first = 0
    for base, buf, bounds, at, h, text in _anchors_of_block(texts):
        stay = _in(h, wanted)
        at, text = at[stay], text[stay]
        keys.append(_keys(buf, bounds, at, text - first))
        of.append(ids[text])
        pos.append(at + base)
        first += len(bounds) - 1
    keys, of, pos = np.concatenate(keys), np.concatenate(of), np.concatenate(pos)
    order = _order(keys)
    keys = keys[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]).any(1)] if len(keys) else np.zeros(0, bool)
    item = np.empty(len(keys), np.int32)
    item[order] = np.cumsum(fresh) - 1
    keys = keys[fresh]
    least = np.minimum.reduceat(of[order], np.flatnonzero(fresh)) if len(keys) else np.zeros(0, np.int64)
    picks = np.unique(np.linspace(0, len(keys) - 1, min(len(keys), 64)).astype(int)) if len(keys) else []
    row = (int(docs["blk"].iloc[0]), len(keys), C.pack(front_code(keys)), C.pack(least.tobytes()), C.pack(np.diff(pos, prepend=0).tobytes()), C.pack(item.tobytes()), [keys[i].tobytes() for i in picks])
    return pd.DataFrame([row], columns=["blk", "n", "run", "docs", "pos", "item", "sample"])


def _cut_runs(splitters: list[bytes]):
    """Cut each run at the splitters; the pieces stay front-coded."""

    def cut(batches):
        for pdf in batches:
            for blk, n, run, docs in zip(pdf["blk"], pdf["n"], pdf["run"], pdf["docs"]):
                _, keys = front_decode(n, C.unpack(run))
                docs, rows = np.frombuffer(C.unpack(docs), np.int64), []
                marks = np.frombuffer(b"".join(keys), np.uint8).reshape(n, KEY)
                bounds = [0, *_bisect(keys, splitters), n]
                for part, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])):
                    if j > i:
                        rows.append((part, blk, i, j - i, C.pack(front_code(marks[i:j])), C.pack(docs[i:j].tobytes())))
                yield pd.DataFrame(rows, columns=["part", "blk", "start", "n", "run", "docs"])

    return cut


def _bisect(keys: list[bytes], splitters: list[bytes]) -> list[int]:
    from bisect import bisect_left

    return [bisect_left(keys, s) for s in splitters]


def merge(runs: list[tuple[list[int], list[bytes]]]):
    """Merge sorted runs with a loser tree: yields (run, position, common prefix with the entry before).

    Each run's head carries the length of its common prefix with the last entry put out. Of two heads the one with
    the longer such prefix comes first; only heads with equal lengths are compared, from that length on, and the
    loser takes the length found. No byte known to be equal is looked at again.
    """
    count = len(runs)
    size = 1
    while size < max(count, 2):
        size *= 2
    end = b"\xff" * (KEY + 1)
    heads = [r[1][0] if r[1] else end for r in runs] + [end] * (size - count)
    known, place = [0] * size, [0] * size
    lens = [len(r[1]) for r in runs] + [0] * (size - count)

    loser = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        h = _shared(heads[a], heads[b], 0, KEY)
        if heads[b] < heads[a]:
            a, b = b, a
        known[b] = h
        loser[node] = b
        return a

    win = build(1)
    while heads[win] is not end:
        at = place[win]
        yield win, at, known[win]
        at += 1
        place[win] = at
        if at < lens[win]:
            heads[win] = runs[win][1][at]
            known[win] = runs[win][0][at]
        else:
            heads[win] = end
            known[win] = 0
        node = (win + size) >> 1
        while node:
            b = loser[node]
            hw, hb = known[win], known[b]
            if hw < hb:
                loser[node], win = win, b
            elif hw == hb:
                kw, kb = heads[win], heads[b]
                if kw is not kb:
                    h = _shared(kw, kb, hw, KEY)
                    if kb < kw:
                        loser[node], win = win, b
                        known[loser[node]] = h
                    else:
                        known[b] = h
            node >>= 1


def _shared(a: bytes, b: bytes, i: int, j: int) -> int:
    """Where a[:j] and b[:j] begin to differ from i on; j if nowhere."""
    x, y = a[i:j], b[i:j]
    if x == y:
        return max(i, j)
    return j - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) >> 3)


def _merge_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge one range of suffixes; tell each block the least doc_id of each of its entries' windows."""
    runs = [front_decode(n, C.unpack(run)) for n, run in zip(pdf["n"], pdf["run"])]
    docs = [np.frombuffer(C.unpack(x), np.int64).tolist() for x in pdf["docs"]]
    starts = pdf["start"].tolist()
    blks = pdf["blk"].tolist()
    out = {b: (array("i"), array("q"), array("i"), array("q")) for b in blks}

    def give(entries, least):
        for r, p in entries:
            mixed = out[blks[r]]
            mixed[2].append(starts[r] + p)
            mixed[3].extend(least)

    def settle(group):
        """group: different keys of one anchor, each with its entries."""
        if len(group) == 1:
            key, entries = group[0]
            least = min(docs[r][p] for r, p in entries)
            for r, p in entries:
                solo = out[blks[r]]
                solo[0].append(starts[r] + p)
                solo[1].append(least)
            return
        if len(group) <= FEW:
            # Two keys share the windows at offsets from 50 - right to left, by what they share on each side.
            least = [[min(docs[r][p] for r, p in entries)] * OFFSETS for _, entries in group]
            own = [x[0] for x in least]
            for i, (a, _) in enumerate(group):
                for j in range(i):
                    b = group[j][0]
                    lo = LENGTH - _shared(a, b, K, min(a[-2], b[-2]))
                    hi = _shared(a, b, LENGTH, LENGTH + min(a[-1], b[-1])) - LENGTH
                    for x, d in ((least[i], own[j]), (least[j], own[i])):
                        for o in range(lo, hi + 1):
                            if d < x[o]:
                                x[o] = d
            for (_, entries), x in zip(group, least):
                give(entries, x)
            return
        # Many keys: one offset after the other, so that only one offset's contents are held at a time.
        own = [min(docs[r][p] for r, p in entries) for _, entries in group]
        least = [array("q", [NONE] * OFFSETS) for _ in group]
        for o in range(OFFSETS):
            by: dict[bytes, int] = {}
            seen = [key[: LENGTH - o] + key[LENGTH : LENGTH + o] if key[-2] >= LENGTH - o and key[-1] >= o else None for key, _ in group]
            for w, d in zip(seen, own):
                if w is not None and by.get(w, NONE) > d:
                    by[w] = d
            for x, w in zip(least, seen):
                if w is not None:
                    x[o] = by.get(w, NONE)
        for (_, entries), x in zip(group, least):
            give(entries, x)

    group: list = []
    for r, p, h in merge(runs):
        if h >= KEY and group:
            group[-1][1].append((r, p))
        elif h >= K and group:
            group.append((runs[r][1][p], [(r, p)]))
        else:
            if group:
                settle(group)
            group = [(runs[r][1][p], [(r, p)])]
    if group:
        settle(group)
    rows = [(b, *(C.pack(x.tobytes()) for x in found)) for b, found in out.items()]
    return pd.DataFrame(rows, columns=["blk", "solo", "least", "mixed", "leasts"])


def _strip(docs: pd.DataFrame, answers: pd.DataFrame, with_text: bool = False, carry: tuple[str, ...] = ()) -> pd.DataFrame:
    """Remove the covered bytes of one block."""
    columns = ["doc_id", "no_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    if not len(docs):
        return pd.DataFrame(columns=[*columns, *carry])
    ids, texts, order = _block(docs)
    none = docs["no_id"].to_numpy(bool)[order]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    cover = np.zeros(bounds[-1] + 1, np.int32)
    own = answers[answers["pos"].notna()]
    if len(own):
        pos, item = np.cumsum(np.frombuffer(C.unpack(own["pos"].iloc[0]), np.int64)), np.frombuffer(C.unpack(own["item"].iloc[0]), np.int32)
        text = np.searchsorted(bounds, pos, side="right") - 1
        told = answers.loc[answers["pos"].isna(), ["solo", "least", "mixed", "leasts"]]
        solo, least, mixed, leasts = (np.frombuffer(b"".join(map(C.unpack, told[c])), t) for c, t in (("solo", np.int32), ("least", np.int64), ("mixed", np.int32), ("leasts", np.int64)))
        n = int(own["n"].iloc[0])
        one = np.full(n, NONE, np.int64)
        one[solo] = least
        # all windows at the anchor have the same answer: one interval
        hit = one[item] < ids[text]
        p, t = pos[hit], text[hit]
        a, b = np.maximum(p - OFFSETS + 1, bounds[t]), np.minimum(p + LENGTH, bounds[t + 1])
        long = b - a >= LENGTH
        np.add.at(cover, a[long], 1)
        np.add.at(cover, b[long], -1)
        place = np.full(n, -1, np.int32)
        place[mixed] = np.arange(len(mixed))
        some = place[item] >= 0
        p, t, leasts = pos[some], text[some], leasts.reshape(-1, OFFSETS)
        row = place[item[some]]
        for o in range(OFFSETS):
            hit = (leasts[row, o] < ids[t]) & (p - o >= bounds[t]) & (p - o + LENGTH <= bounds[t + 1])
            np.add.at(cover, p[hit] - o, 1)
            np.add.at(cover, p[hit] - o + LENGTH, -1)
    gone = np.cumsum(cover)[:-1] > 0
    rows = []
    for i, t in enumerate(texts):
        mask = gone[bounds[i] : bounds[i + 1]]
        removed = int(mask.sum())
        kept, spans = t, 0
        if removed:
            kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
        rows.append((int(ids[i]), bool(none[i]), len(t), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
    out = pd.DataFrame(rows, columns=columns)
    for c in carry:
        out[c] = docs[c].iloc[order].to_numpy()
    return out


def suffix_dedup(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove repeats of 50 bytes or more that also start in a document with a smaller doc_id.

    Reads doc_id and text of ``docs``; returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    kept_text (characters cut in two go whole) and the columns of ``docs`` named in ``carry``. Null text is the empty text. A null doc_id counts as
    larger than all others. Rows that share a doc_id never remove each other's bytes; each is judged and returned
    for itself. Texts below 50 bytes lose nothing. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    blocks = C.block_count(docs)
    buckets = 1 << max(0, (blocks - 1).bit_length())
    blocked = C.keyed(docs, "text", *carry).withColumn("blk", C.block_of(blocks))
    sent = blocked.drop(*carry).groupBy("blk").applyInPandas(_send_hashes(buckets), "blk long, bucket long, hashes binary, many binary")
    back = sent.groupBy("bucket").applyInPandas(_repeated, "blk long, hashes binary")
    runs = C.cut(blocked.drop(*carry).groupBy("blk").cogroup(back.groupBy("blk")).applyInPandas(_make_run, RUNS), "suffix-runs")

    # Splitters: a sample of the runs' own evenly spaced keys, in proportion to the parts, cut to the anchor so that
    # anchors stay whole.
    have, total = (int(x or 0) for x in runs.agg(F.sum(F.size("sample")), F.sum("n")).first())
    taken = runs.select(F.explode("sample").alias("key")).select(F.substring("key", 1, K).alias("key"))
    parts = max(1, -(-total // PER_PART))
    if have > 2 * PICKS * parts:
        taken = taken.sample(PICKS * parts / have, seed=1)
    sample = sorted(bytes(r.key) for r in taken.collect())
    splitters = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    pieces = runs.select("blk", "n", "run", "docs").mapInPandas(_cut_runs(splitters), "part long, blk long, start long, n long, run binary, docs binary")
    answers = pieces.groupBy("part").applyInPandas(_merge_part, ANSWERS)
    nothing = {c: F.lit(None).cast("binary") for c in ("pos", "item", "solo", "least", "mixed", "leasts")}
    both = answers.withColumns({k: nothing[k] for k in ("pos", "item")} | {"n": F.lit(None).cast("long")}).unionByName(
        runs.select("blk", "n", "pos", "item").withColumns({k: nothing[k] for k in ("solo", "least", "mixed", "leasts")})
    )
    schema = OUTPUT + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = blocked.groupBy("blk").cogroup(both.groupBy("blk")).applyInPandas(lambda x, y: _strip(x, y, with_text, carry), schema)
    return out.select(C.doc_id(), *[c for c in out.columns[2:] if with_text or c != "kept_text"])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-array dedup over all of ``documents``."""
    return suffix_dedup(C.table(spark, sf_dir, "documents"))


#: All 50-byte strings of all documents, in hexadecimal; covered bytes as islands, what is left between them.
ORACLE = """
WITH d AS (SELECT doc_id, hex(COALESCE(text, '')) AS hx, CAST(strlen(COALESCE(text, '')) AS BIGINT) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, CAST(i AS INTEGER) AS i, md5_number(substr(hx, 2 * i + 1, 100)) AS string FROM (SELECT doc_id, hx, unnest(range(0, n - 49)) AS i FROM d)),
g AS (SELECT string, min(doc_id) AS least FROM w GROUP BY string HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM w JOIN g ON w.string = g.string WHERE least < doc_id),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM c),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, island),
cuts AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, n, n FROM d),
kept AS (SELECT doc_id, a, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS z FROM cuts),
texts AS (SELECT k.doc_id, string_agg(substr(hx, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS t FROM kept k JOIN d ON d.doc_id = k.doc_id WHERE a > z GROUP BY k.doc_id),
gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(t, ''))) AS kept_sha256
FROM d LEFT JOIN texts ON texts.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id
"""
