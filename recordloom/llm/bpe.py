"""Byte-level BPE: a backtracking encoder over Aho-Corasick longest matches, and a decoder by offset table.

A text is cut into pieces by the tokenizer's pattern. In a piece the encoder takes the longest token that starts at
the current byte (Aho-Corasick), and keeps it if the pair with the token before is *compatible*: merging by rank
would leave the two tokens as they are. If not, it tries the next shorter token that is a prefix, and if there is
none it takes back the token before. A byte position that was given up is marked and never tried again, so the work
is linear in the piece. The tokens are those of merging by rank, without any merging.

Decoding copies slices of one buffer of all tokens' bytes, found by an offset table.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: The piece pattern of byte-level BPE, with white space spelled out.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Pieces that a worker remembers at most; beyond it the older half is forgotten. Bounds memory, not results.
REMEMBERED = 300_000
#: Pairs of tokens whose compatibility a worker remembers at most.
PAIRS = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """Encoder and decoder of a byte-level BPE vocabulary in the ``tokenizers`` JSON format."""

    def __init__(self, definition: str):
        doc = json.loads(definition)
        alphabet = byte_alphabet()
        of = {c: bytes([b]) for b, c in alphabet.items()}
        vocab: dict[str, int] = doc["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in doc["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        pieces = [b""] * size
        for s, i in vocab.items():
            pieces[i] = b"".join(of[c] for c in s)
        for s, i in self.added.items():
            pieces[i] = s.encode()
        # decoding: one buffer and where each token's bytes begin
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=self.offsets[1:])
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        # encoding works on ranks: bytes first, then merges in order
        base = {c: i for i, c in enumerate(alphabet.values())}
        rank = dict(base)
        self.split = [(i, i) for i in range(len(base))]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b not in rank:
                rank[a + b] = len(self.split)
                self.split.append((rank[a], rank[b]))
            self.merged.setdefault((rank[a], rank[b]), rank[a + b])
        names = sorted(rank, key=rank.get)
        self.ids = [vocab[s] for s in names]
        self.length = [len(s) for s in names]
        self.longest = ahocorasick.Automaton()
        for s, r in rank.items():
            self.longest.add_word(s, r)
        self.longest.make_automaton()
        self.shorter = [self._prefix(s, rank) for s in names]
        self.alphabet = alphabet
        self.pattern = regex.compile(PIECES)
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _prefix(s: str, rank: dict[str, int]) -> int:
        """The longest token that is a proper prefix; -1 if none."""
        return next((rank[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in rank), -1)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank keeps tokens a and b apart when they stand side by side.

        Walks down the merge trees along the seam, undoing the later merge first; a merge across the seam that
        comes before the merge undone last would have been made.
        """
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        limit = len(self.split) + 1
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                out = False
                break
            right, left = self.split[a][1], self.split[b][0]
            if a > b and right != a:
                limit, a = a, right
            elif left != b:
                limit, b = b + 1, left
            elif right != a:
                limit, a = a, right
            else:
                out = True
                break
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, packed."""
        alphabet = self.alphabet
        s = "".join([alphabet[b] for b in piece.encode("utf-8", "surrogatepass")])
        n, at = len(s), 0
        dead = bytearray(n + 1)
        tokens: list[int] = []
        length, shorter, find = self.length, self.shorter, self.longest.iter_long
        token = next(find(s))[1]
        while True:
            last = tokens[-1] if tokens else -1
            while True:
                end = at + length[token]
                if not dead[end] and (last < 0 or self.compatible(last, token)):
                    tokens.append(token)
                    at = end
                    if at == n:
                        return np.array([self.ids[t] for t in tokens], np.uint32).tobytes()
                    token = next(find(s, at))[1]
                    break
                token = shorter[token]
                if token < 0:
                    dead[at] = 1
                    token = tokens.pop()
                    at -= length[token]
                    break

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text; special tokens written in it count as such."""
        out: list[bytes] = []
        for part in self.special.split(text) if self.special else [text]:
            if self.special and part in self.added:
                out.append(np.array([self.added[part]], np.uint32).tobytes())
                continue
            young, old = self.young, self.old
            for p in self.pattern.findall(part):
                ids = young.get(p)
                if ids is None:
                    ids = old.get(p)
                    if ids is None:
                        ids = self._piece(p)
                    if len(p) <= 64:
                        young[p] = ids
                        if len(young) >= REMEMBERED // 2:
                            self.old = old = young
                            self.young = young = {}
                out.append(ids)
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a list of token ids."""
        starts = self.offsets[ids]
        lens = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(lens)
        if not len(ids):
            return b""
        at = np.arange(ends[-1]) + np.repeat(starts - ends + lens, lens)
        return self.buffer[at].tobytes()


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(definition: str) -> Tokenizer:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(definition)
    return _loaded[key]


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text of ``docs``; one pass over the scan, no shuffle.

    ``path`` names the vocabulary on the driver; its content (about 2 MB, fixed) is broadcast. Returns doc_id,
    n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded. Null is the empty text, which has no
    tokens; repeated rows are encoded each; a null doc_id stays null; an empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    definition = spark.sparkContext.broadcast(read_definition(path or default_path()))
    decimal = [str(i) for i in range(1 << 16)]

    def encode(batches):
        tok = _tokenizer(definition.value)
        for pdf in batches:
            rows = []
            for doc, none, text in zip(pdf["doc_id"], pdf["no_id"], pdf["text"]):
                ids = tok.encode(text if isinstance(text, str) else "")
                shown = ",".join([decimal[i] if i < 65536 else str(i) for i in ids.tolist()])
                decoded = tok.decode(ids).decode("utf-8", "replace")
                row = (doc, none, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, ids.astype(np.int32), decoded) if with_ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])

    schema = "doc_id long, no_id boolean, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    out = C.keyed(docs, "text").mapInPandas(encode, schema)
    return out.select(C.doc_id(), *out.columns[2:])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE over all of ``documents``."""
    return bpe_encode(C.table(spark, sf_dir, "documents"))
