"""Starts of phrases against names, many pairs at a time: what `phrases.best_in_row` decides for one pair, in arrays.

Inside a cell words are numbers. Which words are forms of each other is found once per different word, so a pair of a start
and a name costs a few lookups of numbers, and only pairs whose first two words fit go on to the next word.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import fixed

PAIRS = 400_000   # pairs that are held in arrays at a time
FOUND = ("site string, lang string, src string, dst string, block int, at int, exact boolean, covered int, extra int, "
         "telling int, hits int, len int, phrase string")
_KEY, _ENDING = 4, 3
_BASE = 2 * fixed.MAX_WORDS + 2


def forms(texts: list[str], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words that `same_form` accepts, as sorted numbers text * len(names) + name, and whether `close_form` does."""
    starts = defaultdict(list)
    for v, word in enumerate(names):
        for n in _stems(word):
            starts[word[:n]].append(v)
    codes, close = [], []
    for u, word in enumerate(texts):
        found = [s for n in _stems(word) if (s := starts.get(word[:n])) is not None]
        if found:
            for v in sorted(set().union(*found)):
                codes.append(u * len(names) + v)
                close.append(_close(word, names[v]))
    return np.array(codes, dtype=np.int64), np.array(close, dtype=bool)


def _stems(word: str) -> range:
    """Lengths at which words with the same beginning are forms of each other, if the length suits both."""
    n = len(word)
    return range(max(_KEY, n - _ENDING), n + 1) if n >= _KEY else range(n, n + 1)


def _close(a: str, b: str) -> bool:
    shorter, longer = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    shared, tail = min(fixed.STRONG_PREFIX, shorter), max(longer - fixed.SHORT_ENDING, 0)
    return a[:shared] == b[:shared] or (shorter >= tail and a[:tail] == b[:tail])


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks) if table.num_rows else pa.array([], table.schema.field(name).type)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return _column(table, name).to_numpy(zero_copy_only=False)


def _coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Number of each word (-1 for null) and the different words."""
    d = words.dictionary_encode()
    return pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _ragged(sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many elements that begin there: (row, element) of every element."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) + np.repeat(begins - _begins(sizes), sizes)


def _among(codes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked number in the sorted ones, and whether it is there."""
    if not len(codes):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    return at, codes[at] == asked


class _Names:
    """Names of a cell: vocabularies one after the other, with what is known of each place."""

    def __init__(self, table: pa.Table):
        vocab, names, telling = (_column(table, c) for c in ("vocab", "names", "distinctive"))
        self.size = _sizes(vocab)
        self.start = _begins(self.size)
        self.word, self.words = _coded(vocab.flatten())
        self.telling = np.zeros(len(self.word), dtype=bool)
        row, _ = _ragged(_sizes(telling), _begins(_sizes(telling)))
        self.telling[self.start[row] + telling.flatten().to_numpy(zero_copy_only=False)] = True
        # the n-th name of every row: its size and the places of its words
        count, each = _sizes(names), names.flatten()
        owner, nth = _ragged(count, np.zeros(len(count), dtype=np.int64))
        length = _sizes(each)
        of, _ = _ragged(length, _begins(length))
        place = self.start[owner[of]] + each.flatten().to_numpy(zero_copy_only=False)
        self.whole, self.holds = [], []
        for n in range(int(count.max(initial=0))):
            size, held = np.zeros(len(count), dtype=np.int64), np.zeros(len(self.word), dtype=bool)
            size[owner[nth == n]] = length[nth == n]
            held[place[nth[of] == n]] = True
            self.whole.append(size)
            self.holds.append(held)


def best_in_cells(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best phrase of every start for every name with the same `_key`: the rows of `best_in_row`, of equal (src, dst) the best.

    left: (_key, site, lang, src, block, at, run, raw, own), own as one text; right: (_key, site, lang, dst, vocab, names, distinctive).
    """
    schema = pa.schema([("site", pa.string()), ("lang", pa.string()), ("src", pa.string()), ("dst", pa.string()), ("block", pa.int32()), ("at", pa.int32()),
                        ("exact", pa.bool_()), *[(c, pa.int32()) for c in ("covered", "extra", "telling", "hits", "len")], ("phrase", pa.string())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    met = pc.is_in(left.column("_key"), pc.unique(right.column("_key")))
    left = left.filter(met)
    size = fixed.MAX_WORDS
    names = _Names(right)
    run = _column(left, "run")
    words, run_size = run.flatten(), _sizes(run)
    coded, texts = _coded(pc.struct_field(words, "w"))
    row, place = _ragged(run_size, np.zeros(len(run_size), dtype=np.int64))
    grid = {}
    for name, flat, none in (("w", coded, -1), ("off", pc.struct_field(words, "off").to_numpy(zero_copy_only=False), 0),
                             ("conj", pc.struct_field(words, "conj").to_numpy(zero_copy_only=False), False)):
        inside = place < size
        grid[name] = np.full((len(run_size), size), none, dtype=np.asarray(flat).dtype)
        grid[name][row[inside], place[inside]] = flat[inside]
    known, close = forms(texts, names.words)
    keys = {k: n for n, k in enumerate({w[:_KEY] for w in texts} | {w[:_KEY] for w in names.words})}
    text_key, name_key = (np.array([keys[w[:_KEY]] for w in ws], dtype=np.int64) for ws in (texts, names.words))
    place_key, n_names = name_key[names.word], len(names.words)

    own, owns = _coded(_column(left, "own"))
    listed = [o.split() for o in owns]
    own_words = {w: n for n, w in enumerate(dict.fromkeys(w for o in listed for w in o))}
    own_known, _ = forms(list(own_words), names.words)
    by_word = np.searchsorted(own_known, np.arange(len(own_words) + 1) * n_names)
    held = [np.int64(n) * n_names + own_known[by_word[own_words[w]]:by_word[own_words[w] + 1]] % n_names for n, o in enumerate(listed) for w in o]
    owned = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *held]))

    def shared(c: str, d: str) -> tuple[np.ndarray, np.ndarray]:
        both, _ = _coded(pa.concat_arrays([_column(left, c), _column(right, d)]))
        return both[:left.num_rows], both[left.num_rows:]

    (site, site_r), (lang, lang_r), (src, dst) = shared("site", "site"), shared("lang", "lang"), shared("src", "dst")
    block, at = _numbers(left, "block").astype(np.int64), _numbers(left, "at").astype(np.int64)

    def first_form(u: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the vocabulary of r of the first word that u is a form of (-1: none), and whether it is a close one."""
        i, f = _ragged(names.size[r], names.start[r])
        same = place_key[f] == text_key[u[i]]
        i, f = i[same], f[same]
        where, hit = _among(known, u[i] * n_names + names.word[f])
        i, f, where = i[hit], f[hit], where[hit]
        first = np.ones(len(i), dtype=bool)
        first[1:] = i[1:] != i[:-1]
        k, strong = np.full(len(u), -1, dtype=np.int64), np.zeros(len(u), dtype=bool)
        k[i[first]], strong[i[first]] = f[first], close[where[first]]
        return k, strong

    def rate(a: np.ndarray, r: np.ndarray) -> pa.Table:
        """Starts a against names r, pair by pair."""
        fits = (src[a] != dst[r]) & (site[a] == site_r[r]) & (lang[a] == lang_r[r]) & (own[a] >= 0) & (grid["w"][a, 1] >= 0)
        a, r = a[fits], r[fits]
        places, strong = [], []
        for j in range(2):
            k, s = first_form(grid["w"][a, j], r)
            fits = k >= 0
            a, r, places, strong = a[fits], r[fits], [x[fits] for x in [*places, k]], [x[fits] for x in [*strong, s]]
        on = np.arange(len(a))
        for j in range(2, size):
            k, s = np.full(len(a), -1, dtype=np.int64), np.zeros(len(a), dtype=bool)
            on = on[grid["w"][a[on], j] >= 0]
            k[on], s[on] = first_form(grid["w"][a[on], j], r[on])
            on = on[k[on] >= 0]
            places.append(k)
            strong.append(s)
        hits, telling = np.ones(len(a), dtype=np.int64), names.telling[places[0]].astype(np.int64)
        inside = [h[places[0]].astype(np.int64) for h in names.holds]
        options = []
        for j in range(1, size):
            k = places[j]
            valid = k >= 0
            new = valid.copy()
            for i in range(j):
                new &= places[i] != k
            hits = hits + new
            telling = telling + (new & names.telling[k])
            covered = np.zeros(len(a), dtype=np.int64)
            for n, (whole, holds) in enumerate(zip(names.whole, names.holds)):
                inside[n] = inside[n] + (new & holds[k])
                covered = np.maximum(covered, np.where(inside[n] == whole[r], whole[r], 0))
            exact = covered > 0
            ok = valid & (hits >= 2) & (exact | ((telling > 0) & ~grid["conj"][a, j] & strong[0] & strong[j]))
            options.append((ok, exact, covered, np.where(exact, covered - hits, 0), telling, hits))
        some = np.logical_or.reduce([o[0] for o in options])
        a, r, places, options = a[some], r[some], [k[some] for k in places], [[x[some] for x in o] for o in options]
        fresh, best = np.zeros(len(a), dtype=bool), np.full(len(a), -1, dtype=np.int64)
        chosen = [np.zeros(len(a), dtype=np.int64) for _ in range(6)]
        for j in range(size):
            _, mine = _among(owned, own[a] * n_names + names.word[places[j]])
            fresh |= (places[j] >= 0) & ~mine
            if not j:
                continue
            ok, exact, covered, extra, tell, hit = options[j - 1]
            off = grid["off"][a, j].astype(np.int64)
            score = np.zeros(len(a), dtype=np.int64)
            for x in (exact, covered, extra + size, tell, hit, size - off):
                score = score * _BASE + x
            better = ok & fresh & (score > best)
            best[better] = score[better]
            for c, x in zip(chosen, (exact, covered, extra, tell, hit, off)):
                c[better] = x[better]
        # of equal pages the best, as `best_per_pair` ranks them
        found = np.flatnonzero(best >= 0)
        found = found[np.lexsort((at[a[found]], -best[found], block[a[found]], -chosen[0][found], dst[r[found]], src[a[found]]))]
        s, d = src[a[found]], dst[r[found]]
        first = np.ones(len(found), dtype=bool)
        first[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        found = found[first]
        a, r, (exact, covered, extra, tell, hit, off) = a[found], r[found], [c[found] for c in chosen]
        texts_of, back = np.unique(a * size + off, return_inverse=True)
        phrases = [" ".join(t[:n + 1]) for t, n in zip(_column(left, "raw").take(pa.array(texts_of // size)).to_pylist(), texts_of % size)]
        of = lambda c: _column(left, c).take(pa.array(a))
        return pa.Table.from_arrays([of("site"), of("lang"), of("src"), _column(right, "dst").take(pa.array(r)), of("block").cast(pa.int32()), of("at").cast(pa.int32()),
                                     pa.array(exact > 0), *[pa.array(x.astype(np.int32)) for x in (covered, extra, tell, hit, -off)],
                                     pa.array(phrases, pa.string()).take(pa.array(back.reshape(-1)))], schema=schema)

    key, key_r = _numbers(left, "_key"), _numbers(right, "_key")
    by_key = np.argsort(key_r, kind="stable")
    low, high = (np.searchsorted(key_r[by_key], key, side) for side in ("left", "right"))
    starts = np.flatnonzero(high > low)
    ends = np.cumsum((high - low)[starts])
    out, done = [schema.empty_table()], 0
    while done < len(starts):
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        part = starts[done:until]
        i, j = _ragged((high - low)[part], low[part])
        out.append(rate(part[i], by_key[j]))
        done = until
    return pa.concat_tables(out)
