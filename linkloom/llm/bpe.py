"""Byte-pair encoding and decoding with a given vocabulary.

Encoding finds, from each position, the longest token (Aho-Corasick automaton over the vocabulary), and
takes it only if the pair with the token before it is compatible: merging the two tokens' bytes must not
cross their border. On a misfit the token is shortened to its next prefix token, or given up and the one
before it is shortened. The first chain of compatible pairs that covers a piece is its merge result, and no
position is tried twice, so the work is linear. Decoding copies bytes by an offset table.
"""

from __future__ import annotations

import json
import struct
from hashlib import sha256
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .texts import map_texts

#: Fixed value: the pre-tokenizer pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES = 1 << 18   # pieces kept per worker and generation; two generations are held
CACHED_PAIRS = 1 << 17    # compatible pairs kept per worker, likewise
CACHED_PIECE_CHARS = 64


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class Pieces(dict):
    """Ids of pieces as bytes, encoded when they are first met. When it is full, the pieces become the older generation and
    those met again come back from there, so frequent ones are never lost."""

    def __init__(self, own: Vocabulary) -> None:
        super().__init__()
        self.own, self.older = own, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            ids = self.own.encode_piece(piece.encode().decode("latin-1"))
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_PIECE_CHARS:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


class Vocabulary:
    """Tokens, merges, pair compatibility and offset table of a byte-level tokenizer file."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, own = data["model"], {c: b for b, c in enumerate(byte_letters())}
        if model["type"] != "BPE" or data["normalizer"] or model.get("ignore_merges") or data["pre_tokenizer"] != {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only plain byte-level BPE files are supported")
        raw = {w: bytes(own[c] for c in w).decode("latin-1") for w in model["vocab"]}
        self.ids = {raw[w]: i for w, i in model["vocab"].items()}
        self.size = max([*self.ids.values(), *(t["id"] for t in data["added_tokens"])]) + 1
        self.text = [""] * self.size
        for t, i in self.ids.items():
            self.text[i] = t
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]):
            if raw[a] + raw[b] in self.ids:
                self.rank.setdefault((self.ids[raw[a]], self.ids[raw[b]]), (n, self.ids[raw[a] + raw[b]]))
        self.parts: dict[int, tuple[int, int, int]] = {}   # token → rank of the merge that makes it, its halves
        for (a, b), (n, c) in self.rank.items():
            if c not in self.parts or n < self.parts[c][0]:
                self.parts[c] = (n, a, b)
        # tokens that their own merges do not give back are never the result of merging
        self.automaton = ahocorasick.Automaton()
        self.reachable: set[str] = set()
        for t, i in self.ids.items():
            if len(t) == 1 or i in self.parts:
                self.automaton.add_word(t, (i, len(t)))
                self.reachable.add(t)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.prefix: dict[str, str] = {}
        self.offsets = np.zeros(self.size + 1, np.int64)
        chunks = [t.encode("latin-1") for t in self.text]
        for t, i in self.special.items():
            chunks[i] = t.encode()
        self.offsets[1:] = np.cumsum([len(c) for c in chunks])
        self.bytes = np.frombuffer(b"".join(chunks), np.uint8)
        self.splitter = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) \
            if self.special else None
        self.pieces = regex.compile(PIECES)
        self.cache = Pieces(self)

    def fits(self, left: int, right: int) -> bool:
        """True if merging the bytes of two tokens leaves exactly these two: no pair across their border, at
        any depth of their merge trees, may merge before both sides are whole."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= CACHED_PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # undo the later of the two last merges, and look whether the facing halves would have merged first
        limit, limit_left = float("inf"), False
        a, b = left, right
        while True:
            over = self.rank.get((a, b))
            # on equal ranks the leftmost place merges first: the tree of the left token, else the border
            if over is not None and (over[0] < limit or over[0] == limit and not limit_left):
                return False
            ra, rb = self.parts.get(a, (-1,))[0], self.parts.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:   # equal tokens: the right one merged last
                limit, limit_left, a = ra, True, self.parts[a][2]
            else:
                limit, limit_left, b = rb, False, self.parts[b][1]

    def shorter(self, token: str) -> str:
        """The longest other token that begins this one; empty if there is none."""
        got = self.prefix.get(token)
        if got is None:
            got = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.reachable), "")
            self.prefix[token] = got
        return got

    def longest(self, piece: str, at: int) -> str:
        """The longest token that starts at a position."""
        for _, (i, _) in self.automaton.iter_long(piece, at):
            return self.text[i]
        raise ValueError("a byte without a token")

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as one letter for each byte."""
        whole = self.ids.get(piece)
        if whole is not None and piece in self.reachable:
            return [whole]
        quick = [i for _, (i, _) in self.automaton.iter_long(piece)]
        if all(self.fits(a, b) for a, b in pairwise(quick)):
            return quick
        taken: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()   # places from which the rest cannot be reached
        at, size = 0, len(piece)
        token = self.longest(piece, 0)
        while at < size:
            end = at + len(token)
            if end not in dead and (not taken or self.fits(taken[-1], self.ids[token])):
                taken.append(self.ids[token])
                starts.append(at)
                at = end
                token = self.longest(piece, at) if at < size else ""
                continue
            token = self.shorter(token)
            while not token:   # nothing fits here: give the place up and shorten the token before it
                dead.add(at)
                at = starts.pop()
                token = self.shorter(self.text[taken.pop()])
        return taken

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit numbers."""
        out, start = [], 0
        for stop, after, special in [*((m.start(), m.end(), self.special[m[0]])
                                       for m in (self.splitter.finditer(text) if self.splitter else ())), (len(text), 0, None)]:
            pieces = self.pieces.findall(text if start == 0 and stop == len(text) else text[start:stop])
            out.append(b"".join(map(self.cache.__getitem__, pieces)))
            if special is not None:
                out.append(struct.pack("<I", special))
                start = after
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens end to end."""
        begin = self.offsets[ids]
        lengths = self.offsets[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(begin - (ends - lengths), lengths)].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        """Text of the tokens; bytes that are no UTF-8 become replacement characters."""
        return self.decode(ids).decode("utf-8", "replace")


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(spec) -> Vocabulary:
    """One vocabulary per worker, built from the broadcast tokenizer file."""
    key = spec.value
    known = _LOADED.get(hash(key))
    if known is None:
        _LOADED.clear()
        known = _LOADED[hash(key)] = Vocabulary(key)
    return known


def shared_file(docs: DataFrame, path: str):
    """The tokenizer file as a broadcast of its text (a few MB, whatever the corpus); only the driver opens it."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `ids` (array<int>) and `decoded` (string, from the ids) to every row, without a shuffle.

    Null and empty texts give no ids and an empty decoded text. Texts are encoded whole. Existing columns
    named `ids` or `decoded` are replaced. Repeated rows are encoded each.
    """
    spec = shared_file(docs, path)

    def work(texts: pa.Array) -> list:
        own = _vocabulary(spec)
        all_ids = [own.encode(t) if t else np.zeros(0, "<u4") for t in texts.to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in all_ids])]).astype(np.int32)
        flat = np.concatenate(all_ids).astype(np.int32) if all_ids else np.zeros(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                pa.array([own.decode_text(x) for x in all_ids], pa.string())]
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields, work)


def digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`n_tokens`, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the text decoded from them, to every row.

    The rows of `encode_decode` in the pass that makes them, so ids and texts do not leave it.
    """
    spec = shared_file(docs, path)

    def work(texts: pa.Array) -> list:
        own, sizes, ids_sha, text_sha = _vocabulary(spec), [], [], []
        for t in texts.to_pylist():
            ids = own.encode(t) if t else np.zeros(0, "<u4")
            sizes.append(len(ids))
            ids_sha.append(sha256(ids.tobytes()).hexdigest())
            text_sha.append(sha256(own.decode_text(ids).encode()).hexdigest())
        return [pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields, work)
