"""Byte-level BPE encoding and decoding by speculation and verification (operator 5).

A text is split into words with array operations. For each new word, greedy longest-match proposes tokens; a
vectorised check then tests every adjacent token pair for compatibility (whether any merge across the boundary would
have come before the merges that built the two tokens). A proposal whose pairs are all compatible is the exact
encoding. Only the failing words are merged step by step, many words at once.

Words are remembered by a hash, and a remembered word counts only after its characters were compared. Words of any
length are proposed and checked alike; very long ones are proposed in pieces of PIECE bytes, whose seams are checked
like any other pair.

Input that is null or empty gives no ids. Very long texts and words are handled whole; a worker holds one text and
its ids at a time. Duplicate rows are encoded alike; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import common

#: Words that a worker remembers between chunks.
CACHE_WORDS = 300_000
#: Bytes of text encoded in one vectorised step.
STEP_BYTES = 1 << 20
#: Bytes of a word that one greedy walk covers.
PIECE = 4096
#: Failing words over this many bytes are merged with a heap each instead of in a padded matrix.
LONG_WORD = 1024
#: Cells of a padded matrix.
CELLS = 1 << 20
# Fixed values of the tokenizer format: the contractions that its splitting pattern names.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class IntMap:
    """Immutable map from unsigned 64-bit keys to int64 values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values, self.full = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)
        left, place = np.arange(len(keys)), (common.mix(keys) & self.mask).astype(np.int64)
        while len(left):
            slots, who = np.unique(place[left], return_index=True)
            free = ~self.full[slots]
            slots, winners = slots[free], left[who[free]]
            self.keys[slots], self.values[slots], self.full[slots] = keys[winners], values[winners], True
            gone = np.zeros(len(keys), bool)
            gone[winners] = True
            left = left[~gone[left]]
            place[left] = (place[left] + 1) & int(self.mask)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        out, place = np.full(len(keys), -1, np.int64), (common.mix(keys) & self.mask).astype(np.int64)
        left = None
        while True:
            at = place if left is None else place[left]
            want = keys if left is None else keys[left]
            full = self.full[at]
            hit = full & (self.keys[at] == want)
            found = np.flatnonzero(hit) if left is None else left[hit]
            out[found] = self.values[place[found]]
            more = full & ~hit
            left = np.flatnonzero(more) if left is None else left[more]
            if not len(left):
                return out
            place[left] = (place[left] + 1) & int(self.mask)


def byte_alphabet() -> dict[str, int]:
    """The format's printable character for each byte: itself where it is printable Latin-1, else 256 onwards in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _classes(splitter) -> np.ndarray:
    """0 space, 1 letter, 2 number, 3 other, for every code point. Where two Unicode versions at hand differ, the
    tokenizer's own splitter is asked."""
    import unicodedata

    import regex

    every = "".join(map(chr, [*range(0xD800), *([0x21] * 0x800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, 3, np.uint8)
    for kind, what in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\s+")):
        for m in regex.finditer(what, every):
            kinds[m.start() : m.end()] = kind
    alone = lambda a, b: len(splitter.pre_tokenize_str(a + b)) == 1
    for c in np.flatnonzero(kinds != 3).tolist():
        if unicodedata.category(chr(c)) == "Cn":
            kinds[c] = next((k for k, beside in ((1, "a"), (2, "1"), (3, "!")) if alone(beside, chr(c))), 0)
    return kinds


class Codec:
    """One tokenizer file. The file's ids are ordered by merge rank within the merges; ranks come from the merge list."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.bytes_of: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for s, k in model["vocab"].items():
            self.bytes_of[k] = raw(s)
        for s, k in self.special.items():
            self.bytes_of[k] = s.encode()
        vocab = {raw(s): k for s, k in model["vocab"].items()}
        self.of_byte = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        n = len(self.bytes_of)
        self.born = np.full(n, -1, np.int64)  # rank of the merge that makes a token; -1 for single bytes
        self.left, self.right = np.arange(n), np.arange(n)
        keys, made = [], []
        for rank, (a, b) in enumerate(model["merges"]):
            x, y = model["vocab"][a], model["vocab"][b]
            z = model["vocab"][a + b]
            keys.append(x << 32 | y)
            made.append(z)
            self.born[z], self.left[z], self.right[z] = rank, x, y
        self.merge = IntMap(np.array(keys, np.uint64), np.arange(len(keys)))
        self.made = np.array(made, np.int64)
        self._trie(vocab)
        self.kinds = _classes(Tokenizer.from_file(path).pre_tokenizer)
        self.dtype = np.uint16 if n <= 1 << 16 else np.uint32
        lengths = np.array([len(b) for b in self.bytes_of])
        self.flat, self.flat_at, self.flat_len = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(lengths) - lengths, lengths
        self._forget()

    def _trie(self, vocab: dict[bytes, int]) -> None:
        nodes, ends = {b"": 0}, []
        edges = []
        for word, k in vocab.items():
            for j in range(1, len(word) + 1):
                if word[:j] not in nodes:
                    nodes[word[:j]] = len(nodes)
                    edges.append((nodes[word[: j - 1]] << 8 | word[j - 1], nodes[word[:j]]))
            ends.append((nodes[word], k))
        self.step = IntMap(np.array([e for e, _ in edges], np.uint64), np.array([n for _, n in edges], np.int64))
        self.token_at = np.full(len(nodes), -1, np.int64)
        for node, k in ends:
            self.token_at[node] = k

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.seen, self.known_keys, self.waiting = IntMap(np.zeros(0, np.uint64), none), np.zeros(0, np.uint64), []
        self.known_at, self.known_len, self.known_ids = none, none, none
        self.spelt, self.spelt_at, self.spelt_len = np.zeros(0, np.uint32), none, none

    def _learn(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, spelt: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers words with their characters; the map is built anew when those that wait are a third of what it holds."""
        self.waiting.append((keys, ids, counts, spelt, sizes))
        if sum(len(w[0]) for w in self.waiting) < max(10_000, len(self.known_keys) // 3):
            return
        self.waiting, new = [], self.waiting
        _, first = np.unique(np.concatenate([w[0] for w in new]), return_index=True)  # words that came twice while waiting
        counts, sizes = np.concatenate([w[2] for w in new]), np.concatenate([w[4] for w in new])
        self.known_at = np.concatenate((self.known_at, (len(self.known_ids) + np.cumsum(counts) - counts)[first]))
        self.spelt_at = np.concatenate((self.spelt_at, (len(self.spelt) + np.cumsum(sizes) - sizes)[first]))
        self.known_len, self.spelt_len = np.concatenate((self.known_len, counts[first])), np.concatenate((self.spelt_len, sizes[first]))
        self.known_ids = np.concatenate([self.known_ids, *(w[1] for w in new)])
        self.spelt = np.concatenate([self.spelt, *(w[3] for w in new)])
        self.known_keys = np.concatenate((self.known_keys, np.concatenate([w[0] for w in new])[first]))
        self.seen = IntMap(self.known_keys, np.arange(len(self.known_keys)))

    # -- splitting -----------------------------------------------------------------------------------------------

    def split(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where words begin. codes: code points; edges: True where a text (or a piece beside a special token) begins."""
        n = len(codes)
        kind = self.kinds[codes]
        change = edges[:n].copy()
        change[0] = True
        change[1:] |= kind[1:] != kind[:-1]
        starts = change.copy()
        # a run of other than space that follows space in the same text takes a last blank with it; a last space of
        # another kind, or one that others precede, stands alone
        after = np.flatnonzero(change & (kind != 0))
        after = after[(after > 0) & ~edges[after]]
        after = after[kind[after - 1] == 0]
        starts[after - 1] = True
        starts[after[codes[after - 1] == 32]] = False
        quotes = np.flatnonzero(starts[: n - 1] & (codes[: n - 1] == 39) & (kind[1:] == 1) & ~edges[1:n])
        if len(quotes):
            width = np.zeros(len(quotes), np.int64)
            for word in CONTRACTIONS[::-1]:
                ok = np.ones(len(quotes), bool)
                for j, c in enumerate(word, 1):
                    at = np.minimum(quotes + j, n - 1)
                    ok &= (quotes + j < n) & (codes[at] == ord(c)) & ~edges[at]
                width[ok] = len(word)
            quotes, width = quotes[width > 0], width[width > 0]
            starts[quotes + 1] = False
            beyond = quotes + 1 + width
            starts[beyond[beyond < n]] = True
        return np.flatnonzero(starts)

    # -- encoding of words ---------------------------------------------------------------------------------------

    def greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of longest matches from the left, in the order of the words."""
        words, tokens = [], []
        live, pos = np.arange(len(starts)), starts.copy()
        node, best, best_end = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64), starts.copy()
        while len(live):
            more = pos < ends[live]
            node[more] = self.step.get((node[more].astype(np.uint64) << np.uint64(8)) | data[pos[more]])
            walks = more & (node >= 0)
            pos = pos + walks
            token = np.where(walks, self.token_at[node], -1)
            hit = token >= 0
            best[hit], best_end[hit] = token[hit], pos[hit]
            stop = ~walks
            words.append(live[stop])
            tokens.append(best[stop])
            pos[stop], node[stop] = best_end[stop], 0
            keep = ~stop | (pos < ends[live])
            live, pos, node, best, best_end = live[keep], pos[keep], node[keep], best[keep], best_end[keep]
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b after a stays [a, b]: seen backwards in time, no boundary merge precedes what consumed its sides."""
        ok, left = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        never = np.int64(1 << 40)
        x_dies, y_dies = np.full(len(a), never), np.full(len(a), never)  # rank of the merge that consumes each side
        while len(left):
            rank = self.merge.get((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64))
            # on equal ranks the merge further left comes first: x's own before the boundary, the boundary before y's
            bad = (rank >= 0) & (rank < x_dies) & (rank <= y_dies)
            ok[left[bad]] = False
            bx, by = self.born[x], self.born[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            left, x, y, x_dies, y_dies, bx, by = left[go], x[go], y[go], x_dies[go], y_dies[go], bx[go], by[go]
            undo_x = bx >= by  # the younger side is taken apart
            x_dies, y_dies = np.where(undo_x, bx, x_dies), np.where(undo_x, y_dies, by)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) by exact merging: in each word the lowest-ranked pair, leftmost first, until none is left."""
        lengths = ends - starts
        out_w, out_t = [], []
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            fits = np.searchsorted(np.arange(1, len(order) - at + 1) * lengths[order[at:]], CELLS, "right")
            rows = order[at : at + max(1, int(fits))]
            at += len(rows)
            width = int(lengths[rows].max())
            none = np.int64(1 << 40)
            grid = np.full((len(rows), width + 1), -1, np.int64)
            grid[np.arange(width + 1) < lengths[rows][:, None]] = self.of_byte[data[common.ragged(starts[rows], lengths[rows])]]
            rank = np.full((len(rows), width + 1), none)  # of the pair that begins at each place
            both = grid[:, 1:] >= 0
            rank[:, :-1][both] = self._ranked(grid[:, :-1][both], grid[:, 1:][both])
            live, g, k = np.arange(len(rows)), grid.copy(), rank
            while len(live):
                where = k.argmin(1)
                low = k[np.arange(len(live)), where]
                go = low < none
                if not go.all():
                    done = live[~go]
                    grid[done] = -1
                    grid[done, : g.shape[1]] = g[~go]
                    live, g, k, where, low = live[go], g[go], k[go], where[go], low[go]
                    if not len(live):
                        break
                width = int((g >= 0).sum(1).max())
                g, k = g[:, : width + 1], k[:, : width + 1]
                beyond = np.arange(width) > where[:, None]
                g[:, :-1] = np.where(beyond, g[:, 1:], g[:, :-1])
                k[:, :-1] = np.where(beyond, k[:, 1:], k[:, :-1])
                g[:, -1], k[:, -1] = -1, none
                row = np.arange(len(live))
                g[row, where] = self.made[low]
                k[row, where] = self._ranked(g[row, where], g[row, where + 1])
                inner = where > 0
                r, at_ = row[inner], where[inner] - 1
                k[r, at_] = self._ranked(g[r, at_], g[r, at_ + 1])
            r, c = np.nonzero(grid >= 0)
            out_w.append(rows[r])
            out_t.append(grid[r, c])
        words, tokens = np.concatenate(out_w), np.concatenate(out_t)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of token pairs; a large number where no merge exists (or b is padding)."""
        out = np.full(len(a), np.int64(1 << 40))
        real = b >= 0
        got = self.merge.get((a[real].astype(np.uint64) << np.uint64(32)) | b[real].astype(np.uint64))
        out[real] = np.where(got < 0, np.int64(1 << 40), got)
        return out

    def merged_long(self, word: bytes) -> list[int]:
        """Exact merging of one long word with a heap over a linked list."""
        import heapq

        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        rank_of = lambda i, j: self._rank(ids[i], ids[j])
        nxt, prv, heap = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], []
        for i in range(len(ids) - 1):
            if (r := rank_of(i, i + 1)) >= 0:
                heap.append((r, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = int(self.made[r]), -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (q := rank_of(x, y)) >= 0:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [k for k in ids if k >= 0]

    def _rank(self, a: int, b: int) -> int:
        if not hasattr(self, "_ranks"):
            full = self.merge.full
            self._ranks = dict(zip(self.merge.keys[full].tolist(), self.merge.values[full].tolist(), strict=True))
        return self._ranks.get(a << 32 | b, -1)

    def words(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        lengths = np.fromiter(map(len, items), np.int64, len(items))
        if not lengths.any():
            return np.zeros(0, np.int64), np.zeros(len(items), np.int64)
        data = np.frombuffer(b"".join(items), np.uint8)
        begins = np.cumsum(lengths) - lengths
        pieces = -(-lengths // PIECE)
        word = np.repeat(np.arange(len(items)), pieces)
        starts = begins[word] + PIECE * common.ragged(np.zeros(len(items), np.int64), pieces)
        piece, tokens = self.greedy(data, starts, np.minimum(starts + PIECE, (begins + lengths)[word]))
        owner = word[piece]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fails = np.zeros(len(items), bool)
        fails[owner[inner[~self.compatible(tokens[inner], tokens[inner + 1])]]] = True
        if fails.any():
            good = ~fails[owner]
            bad = np.flatnonzero(fails & (lengths <= LONG_WORD))
            again, merged = self.merged(data, begins[bad], begins[bad] + lengths[bad]) if len(bad) else (bad, bad)
            long = [(k, self.merged_long(items[k])) for k in np.flatnonzero(fails & (lengths > LONG_WORD)).tolist()]
            owner = np.concatenate((owner[good], bad[again], *(np.full(len(ids), k) for k, ids in long)))
            tokens = np.concatenate((tokens[good], merged, *(np.array(ids, np.int64) for _, ids in long)))
        order = np.argsort(owner, kind="stable")
        return tokens[order], np.bincount(owner, minlength=len(items))

    # -- encoding of texts ---------------------------------------------------------------------------------------

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        blob = data.tobytes()
        text = blob.decode()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        where = lead[offsets]
        edges = np.zeros(len(codes) + 1, bool)
        edges[where] = True
        specials = [(m, token) for token in self.special for m in self._found(blob, token.encode(), offsets)]
        inside = np.zeros(len(codes), bool)
        for at, token in specials:
            a = lead[at]
            edges[a] = edges[a + len(token)] = inside[a + 1 : a + len(token)] = True
        starts = self.split(codes, edges)
        if specials:
            starts = starts[~inside[starts]]
        ends = np.append(starts[1:], len(codes))
        keys, sizes = self.hashed(codes, starts, ends), ends - starts
        slot = self.seen.get(keys)
        old = np.flatnonzero(slot >= 0)
        same = self.spelt_len[slot[old]] == sizes[old]
        same[same] = ~common.unequal(codes, starts[old[same]], self.spelt, self.spelt_at[slot[old[same]]], sizes[old[same]])
        alike = [old[~same]]  # words of a remembered word's hash that aren't that word
        old = old[same]
        at, per_word, ids = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), self.known_ids
        at[old], per_word[old] = self.known_at[slot[old]], self.known_len[slot[old]]
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            uniq, first, which = np.unique(keys[missing], return_index=True, return_inverse=True)
            first = missing[first]
            head = first[which]
            same = sizes[head] == sizes[missing]
            same[same] = ~common.unequal(codes, starts[missing[same]], codes, starts[head[same]], sizes[missing[same]])
            alike.append(missing[~same])
            missing, which = missing[same], which[same]
            got, counts = self.spelled([text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            begin = len(ids) + np.cumsum(counts) - counts
            ids = np.concatenate((ids, got))
            at[missing], per_word[missing] = begin[which], counts[which]
            if len(self.known_keys) < CACHE_WORDS:
                self._learn(uniq, got, counts, codes[common.ragged(starts[first], sizes[first])], sizes[first])
        odd = np.concatenate(alike)
        if len(odd):
            items = [text[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
            distinct = {x: k for k, x in enumerate(dict.fromkeys(items))}
            got, counts = self.spelled(list(distinct))
            begin, which = len(ids) + np.cumsum(counts) - counts, np.array([distinct[x] for x in items])
            ids = np.concatenate((ids, got))
            at[odd], per_word[odd] = begin[which], counts[which]
        flat = ids[common.ragged(at, per_word)].astype(self.dtype)
        sums = np.concatenate(([0], np.cumsum(per_word)))
        bounds = sums[np.searchsorted(starts, where)]
        return flat, np.diff(bounds)

    def hashed(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """By these keys words are looked up; what is found is compared."""
        return common.span_hashes(codes, starts, ends)

    def spelled(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """words() for strings, any of which may be a special token."""
        got, counts = self.words([b"" if x in self.special else x.encode() for x in items])
        for k, x in enumerate(items):
            if x in self.special:
                got, counts[k] = np.insert(got, int(counts[:k].sum()), self.special[x]), 1
        return got, counts

    def _found(self, blob: bytes, token: bytes, offsets: np.ndarray) -> Iterator[int]:
        at = blob.find(token)
        while at >= 0:
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(token) - 1, "right"):
                yield at
                at = blob.find(token, at + len(token))
            else:
                at = blob.find(token, at + 1)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the ids stand for; what isn't UTF-8 becomes U+FFFD."""
        k = ids.astype(np.int64)
        raw = self.flat[common.ragged(self.flat_at[k], self.flat_len[k])].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def codec(path: str) -> Codec:
    return common.kept(path, lambda: Codec(path))


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `ids` (binary, little-endian unsigned integers of the codec's width as uint32) and `n_tokens`."""
    keep = keep or [c for c in df.columns if c != text]
    schema = df.select(*keep).schema.add("n_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rows, data, offsets in common.chunks(batches, text, STEP_BYTES, keep=True):
            ids, counts = c.encode(data, offsets)
            cols = [rows.column(rows.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts), common.binaries(ids.astype("<u4"), np.concatenate(([0], np.cumsum(counts))))], names=schema.names)

    common.prepare(df.sparkSession)
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds `decoded`, the text of a column of ids as encode() makes it."""
    keep = keep or [c for c in df.columns if c != ids]
    schema = df.select(*keep).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rows in batches:
            out = [None if x is None else c.decode(np.frombuffer(x, "<u4")).decode() for x in rows.column(rows.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(k)) for k in keep), pa.array(out, pa.string())], names=schema.names)

    common.prepare(df.sparkSession)
    return df.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids, SHA-256 of what they decode to. Encodes and decodes in one pass."""
    schema = df.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), lambda b: hashlib.sha256(b).hexdigest()
        for rows, data, offsets in common.chunks(batches, text, STEP_BYTES, keep=True):
            ids, counts = c.encode(data, offsets)
            ends = np.cumsum(counts)
            parts = [ids[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts), pa.array([sha(p.astype("<u4").tobytes()) for p in parts], pa.string()), pa.array([sha(c.decode(p)) for p in parts], pa.string())], names=schema.names)

    common.prepare(df.sparkSession)
    return df.select(key, text).mapInArrow(run, schema)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"), vocabulary())
