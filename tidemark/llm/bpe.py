"""Byte-pair encoding of blocks of documents in numpy.

A document is cut at white space into chunks that the tokenizer's own pre-tokenizer
never joins; each distinct chunk of a block is split and encoded once and documents are
assembled by gathering. Two encoders of pre-tokens exist: :class:`PairMerger` applies
the merges in order of rank to all distinct pre-tokens at once, :class:`MergeAutomaton`
runs them through a deterministic automaton whose arcs are tokens.

Both take ``tokenizers`` files of kind BPE, byte-level with or without ``</w>`` ends.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

NONE = np.int32(2**31 - 1)
#: Pre-tokens with more symbols are encoded one by one.
LONG = 40
#: Arcs of the automaton that a task holds at once (5 bytes each).
ARCS = 1 << 20
#: Distinct chunks remembered by a task before it starts afresh.
REMEMBERED = 400_000

_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The fast patterns run over many chunks joined by NUL, which they give as a match of its own.
_WORD_FAST = re.compile("\0|" + _CONTRACTIONS + r"|[^\W\d_]+|\d|(?:[^\w\s\0]|_)+")
_WORD_FULL = regex.compile(_CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_BYTE_FAST = re.compile("\0|" + _CONTRACTIONS + r"| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s\0]|_)+|\s+(?![^\s\0])|\s+")
_BYTE_FULL = regex.compile(
    _CONTRACTIONS
    + r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Outside these characters (ASCII without the separators, Latin letters) ``re`` and Unicode classes may differ.
_UNUSUAL = re.compile("[^\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ſ]")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"\p{White_Space}+")
_SPACE_RUN = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")
_CUT_FULL = regex.compile(r" (?=\P{White_Space})")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


class Table:
    """A hash table from unsigned 32-bit keys to int32, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, 2**32 - 1, np.uint32), np.full(size, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.values[slot[left]] == NONE
            now, at = left[free], slot[left[free]]
            self.keys[at], self.values[at] = keys[now], values[now]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, ``NONE`` where there is none."""
        keys = keys.astype(np.uint32)
        slot = self._slot(keys)
        found = self.values[slot]
        left = np.flatnonzero((self.keys[slot] != keys) & (found != NONE))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            found[left] = self.values[slot[left]]
            left = left[(self.keys[slot[left]] != keys[left]) & (found[left] != NONE)]
        return found


def gather(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated runs ``start[c] .. start[c] + length[c]`` for each code."""
    n = length[codes].astype(np.int64)
    before = np.cumsum(n) - n
    return np.repeat(start[codes] - before, n) + np.arange(n.sum())


class Vocabulary:
    """Merges and base symbols of a ``tokenizers`` BPE file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, ids = file["model"], file["model"]["vocab"]
        if model.get("type", "BPE") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE is supported")
        self.ends = model["end_of_word_suffix"] or ""
        self.kind = "word" if self.ends else "byte"
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.labels = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        if len(self.labels) > 1 << 16:
            raise ValueError("ids from 65,536 on are not supported: a pair of ids is a 32-bit key")
        for token, i in [*ids.items(), *self.special.items()]:
            self.labels[i] = token
        shown = byte_symbols()
        self.base = np.array([ids[c] for c in shown], np.int32)
        self.last = np.array([ids[c + self.ends] for c in shown], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.rank = Table(self.pair(self.left, self.right), np.arange(len(pairs), dtype=np.int32))
        self.left_list, self.right_list, self.made_list = self.left.tolist(), self.right.tolist(), self.made.tolist()
        self.rank_of = {(int(a) << 16) + int(b): k for k, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint32) * np.uint32(65536) + b.astype(np.uint32)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Base tokens of all words one after another, and each word's number of them."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        out = self.base[raw]
        end = np.cumsum(size)[size > 0] - 1
        out[end] = self.last[raw[end]]
        return out, size


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairMerger:
    """Encodes many pre-tokens at once: each round merges, in every word, the first pair of lowest rank.

    A word of more than ``LONG`` symbols is merged by itself with a heap of its pairs over a linked list, in
    time n log n, so that an unbroken text of a megabyte is no worse than others.
    """

    def __init__(self, vocab: Vocabulary):
        self.v = vocab

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number for each word."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.zeros(len(words), np.int32)
        for own, n, ids in self._merged(words):
            size[own] = n
            parts.append((own, ids))
        return _in_order(parts, size)

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word."""
        size = np.zeros(len(words), np.int32)
        for own, n, _ in self._merged(words):
            size[own] = n
        return size

    def _merged(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of words that are done, their numbers of symbols, and these one after another."""
        v = self.v
        for i in [i for i, w in enumerate(words) if len(w) > LONG]:
            ids = self._merge_one(words[i])
            yield np.array([i]), np.array([len(ids)]), ids
        short = [w if len(w) <= LONG else b"" for w in words]
        sym, size = v.symbols(short)
        live = np.flatnonzero(size > 0)
        sym_n = size[live]
        if not len(live):
            return
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = v.rank.get(v.pair(sym[:-1], sym[1:]))
        rank[np.cumsum(sym_n) - 1] = NONE
        while len(live):
            begin = np.cumsum(sym_n) - sym_n
            least = np.minimum.reduceat(rank, begin)
            done = least == NONE
            if done.any():
                keep = np.repeat(~done, sym_n)
                yield live[done], sym_n[done], sym[~keep]
                live, sym_n, least, sym, rank = live[~done], sym_n[~done], least[~done], sym[keep], rank[keep]
                if not len(live):
                    break
                begin = np.cumsum(sym_n) - sym_n
            at = np.flatnonzero(rank == np.repeat(least, sym_n))
            word = np.searchsorted(begin, at, side="right") - 1
            at = at[np.concatenate(([True], word[1:] != word[:-1]))]
            sym[at] = v.made[least]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]
            sym, rank, sym_n = sym[keep], rank[keep], sym_n - 1
            at = at - np.arange(len(at))
            begin = np.cumsum(sym_n) - sym_n
            for here, inside in ((at, at < begin + sym_n - 1), (at - 1, at > begin)):
                i = here[inside]
                rank[i] = v.rank.get(v.pair(sym[i], sym[i + 1]))
            last = at[at == begin + sym_n - 1]
            rank[last] = NONE

    def _merge_one(self, word: bytes) -> np.ndarray:
        v = self.v
        start = v.symbols([word])[0]
        first = v.rank.get(v.pair(start[:-1], start[1:]))
        at = np.flatnonzero(first != NONE)
        heap = ((first[at].astype(np.int64) << 32) + at).tolist()
        heapq.heapify(heap)
        sym, n = start.tolist(), len(start)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, made, left, right = v.rank_of.get, v.made_list, v.left_list, v.right_list
        while heap:
            r, i = divmod(heapq.heappop(heap), 1 << 32)
            j = after[i]
            if sym[i] != left[r] or j >= n or sym[j] != right[r]:
                continue  # one of the two is no longer there
            sym[i], sym[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := rank_of((sym[i] << 16) + sym[k])) is not None:
                    heapq.heappush(heap, (new << 32) + i)
            h = before[i]
            if h >= 0 and (new := rank_of((sym[h] << 16) + sym[i])) is not None:
                heapq.heappush(heap, (new << 32) + h)
        return np.array([x for x in sym if x >= 0], np.int32)


def _in_order(parts: list[tuple[np.ndarray, np.ndarray]], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.cumsum(size, dtype=np.int64) - size
    out = np.empty(int(size.sum()), np.int32)
    for words, ids in parts:
        out[gather(words, start, size)] = ids
    return out, size


class MergeAutomaton:
    """A deterministic automaton over tokens, compiled from the merges.

    It starts as one state with a loop for each base symbol. The gadget of the merge
    ``(u, v) -> uv`` gives ``u``'s arcs a target of their own without an arc ``v``, and
    every state with an arc ``u`` an arc ``uv`` to ``v``'s target at that time. So all
    arcs of one label share their target, a state is named by the label that leads to
    it, and the arc ``t`` leaves the state of ``s`` unless a gadget removed it: a merge
    ``(x, y)`` with ``x`` on the right edge of ``s`` and ``y`` on the left edge of ``t``,
    made while these two stood at the border. The full table of arcs has thousands of
    millions of entries. So the gadgets are kept as their history (time, left and right
    part of each label, the pair removed), from which :meth:`arc` compiles single arcs,
    and the arcs that words meet are entered into the transition table of the task, a
    hash table of fixed size which all words share (:meth:`step`); where two arcs want
    one place the later stands. The tests apply gadgets one after another
    (:func:`apply_gadgets`) and compare arc by arc.

    A word's tokens are the labels on its only path. It is found from left to right with
    tables alone: from each place reached, a trie gives the tokens that begin there, and
    the transition table tells which one may follow.
    """

    def __init__(self, vocab: Vocabulary):
        v = self.v = vocab
        n = len(v.labels)
        self.born, self.part_l, self.part_r = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.length = np.ones(n, np.int32)
        spell: dict[int, list[int]] = {}
        for b in range(256):
            spell[int(v.base[b])] = [b]
            if v.ends:
                spell[int(v.last[b])] = [b + 256]
        keys, kids, accept, edges = [], [], [-1], {}
        for k, (a, b, c) in enumerate(zip(v.left.tolist(), v.right.tolist(), v.made.tolist(), strict=True)):
            self.born[c], self.part_l[c], self.part_r[c] = k, a, b
            spell[c] = spell[a] + spell[b]
            self.length[c] = len(spell[c])
        self._one = [x.tolist() for x in (self.born, self.part_l, self.part_r)]
        dead: set[int] = set()  # labels whose gadget finds no arc from one part to the other
        when = np.arange(len(v.made), dtype=np.int32)
        apart = ~self.arc(v.left, v.right, when)
        for a, b, c, no in zip(v.left.tolist(), v.right.tolist(), v.made.tolist(), apart.tolist(), strict=True):
            if no or a in dead or b in dead:
                dead.add(c)
        for token, path in spell.items():
            if token in dead:
                continue
            node = 0
            for s in path:
                key = node * 512 + s
                if key not in edges:
                    edges[key] = len(accept)
                    keys.append(key)
                    kids.append(len(accept))
                    accept.append(-1)
                node = edges[key]
            accept[node] = token
        self.trie, self.accept = Table(np.array(keys, np.uint32), np.array(kids, np.int32)), np.array(accept, np.int32)
        self.arc_keys, self.arc_there = np.full(ARCS, 2**32 - 1, np.uint32), np.zeros(ARCS, bool)

    def step(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """:meth:`arc` by the transition table, which learns the arcs that it lacks."""
        key = self.v.pair(np.maximum(state, 0), label)
        slot = (key * np.uint32(2654435769)) >> np.uint32(32 - ARCS.bit_length() + 1)
        ok = self.arc_there[slot] | (state < 0)
        new = np.flatnonzero((self.arc_keys[slot] != key) & (state >= 0))
        if len(new):
            ok[new] = self.arc(state[new], label[new])
            self.arc_keys[slot[new]] = key[new]
            # of several arcs for one place the last assignment stands for both arrays
            self.arc_there[slot[new]] = ok[new]
        return ok

    def arc(self, state: np.ndarray, label: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the state reached by each token has an arc with each label; state -1 is the start. ``before``: ahead
        of the gadget of that number (default: after all)."""
        ok = np.ones(len(state), bool)
        at = np.flatnonzero(state >= 0)
        s, t = state[at].copy(), label[at].copy()
        # gadgets from this one on came after the border changed
        before = np.full(len(at), NONE, np.int32) if before is None else before[at]
        while len(at):
            gone = self.v.rank.get(self.v.pair(s, t)) < before
            ok[at[gone]] = False
            stay = ~gone & ((self.born[s] >= 0) | (self.born[t] >= 0))
            at, s, t = at[stay], s[stay], t[stay]
            newer = self.born[s] > self.born[t]
            before = np.where(newer, self.born[s], self.born[t] + 1)
            s, t = np.where(newer, self.part_r[s], s), np.where(newer, t, self.part_l[t])
        return ok

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number for each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out_size = np.zeros(len(words), np.int32)
        parts = []
        edge = [0, 8, 16, LONG]
        for low, high in zip(edge, edge[1:], strict=False):
            some = np.flatnonzero((size > low) & (size <= high))
            if len(some):
                ids, n = self._lockstep([words[i] for i in some.tolist()], size[some], high)
                out_size[some] = n
                parts.append((some, ids))
        for i in np.flatnonzero(size > LONG).tolist():
            ids = self._walk(words[i])
            out_size[i] = len(ids)
            parts.append((np.array([i]), ids))
        return _in_order(parts, out_size)

    def _spelling(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = raw.astype(np.uint32)
        if self.v.ends:
            out[ends] += 256
        return out

    def _lockstep(self, words: list[bytes], size: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        text = np.zeros((n, wide), np.uint32)
        inside = np.arange(wide) < size[:, None]
        text[inside] = self._spelling(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - 1)
        state = np.full((n, wide + 1), -1, np.int32)
        for i in range(wide):
            row = np.flatnonzero(size > i)
            node = np.zeros(len(row), np.int32)
            for j in range(i, wide):
                node = self.trie.get(node.astype(np.uint32) * np.uint32(512) + text[row, j])
                on = node != NONE
                row, node = row[on], node[on]
                if not len(row):
                    break
                token = self.accept[node]
                may = np.flatnonzero(token >= 0)
                fit = may[self.step(state[row[may], i], token[may])]
                state[row[fit], j + 1] = token[fit]
                on = size[row] > j + 1
                row, node = row[on], node[on]
        back = np.full((n, wide), -1, np.int32)
        at, row, k = size.copy(), np.arange(n), wide
        while len(row):
            k -= 1
            token = state[row, at[row]]
            back[row, k] = token
            at[row] -= self.length[token]
            row = row[at[row] > 0]
        return back[back >= 0], (back >= 0).sum(1)

    def _walk(self, word: bytes) -> np.ndarray:
        """The same for one long word, in memory proportional to its length."""
        text = self._spelling(np.frombuffer(word, np.uint8), np.array([len(word) - 1]))
        state = np.full(len(word) + 1, -1, np.int32)
        for begin in range(0, len(word), 4096):  # tokens that begin in this stretch, then its places in order
            place = np.arange(begin, min(len(word), begin + 4096))
            node, found, step = np.zeros(len(place), np.int32), [], 0
            while len(place):
                node = self.trie.get(node.astype(np.uint32) * np.uint32(512) + text[place + step])
                on = node != NONE
                place, node = place[on], node[on]
                token = self.accept[node]
                may = token >= 0
                found += zip(place[may].tolist(), token[may].tolist(), [step + 1] * int(may.sum()), strict=True)
                step += 1
                on = place + step < len(word)
                place, node = place[on], node[on]
            for i, token, n in sorted(found):
                if self._arc_of_one(int(state[i]), token):
                    state[i + n] = token
        out, at = [], len(word)
        while at > 0:
            out.append(state[at])
            at -= self.length[state[at]]
        return np.array(out[::-1], np.int32)

    def _arc_of_one(self, s: int, t: int) -> bool:
        """:meth:`arc` for one state and label."""
        born, part_l, part_r = self._one
        before = len(self.v.rank_of)
        while s >= 0:
            if self.v.rank_of.get((s << 16) + t, before) < before:
                return False
            if born[s] < 0 and born[t] < 0:
                break
            if born[s] > born[t]:
                before, s = born[s], part_r[s]
            else:
                before, t = born[t] + 1, part_l[t]
        return True


def apply_gadgets(base: list[int], merges: list[tuple[int, int, int]]) -> list[dict[int, int]]:
    """The automaton of a small vocabulary with all its arcs: for each state (0 is the start) label -> state.

    Applies the gadget of each merge ``(u, v, uv)`` in turn. Its size is that of the states times the labels.
    """
    arcs: list[dict[int, int]] = [dict.fromkeys(base, 0)]
    for u, v, uv in merges:
        target = next((a[u] for a in arcs if u in a), None)  # the same for all arcs of one label
        if target is None or v not in arcs[target]:
            continue
        last = arcs[target][v]
        arcs.append({k: x for k, x in arcs[target].items() if k != v})
        own = len(arcs) - 1
        for a in arcs:
            if u in a:
                a[u], a[uv] = own, last
    return arcs


class Codes(dict):
    """Numbers keys in order of appearance; ``new`` lists those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        return code


class TextEncoder:
    """Encodes blocks of whole texts just as ``tokenizers`` does without added special tokens.

    Special strings inside a text become their own id, as is the library's default.
    """

    def __init__(self, path: str, automaton: bool = False):
        self.v = vocabulary(path)
        self.words = MergeAutomaton(self.v) if automaton else PairMerger(self.v)
        self._forget()

    def _forget(self) -> None:
        self.code = Codes()
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        special = list(self.v.special.items())
        for _, i in special:
            self.code[i, "special"]
        self.ids = np.array([i for _, i in special], np.int32)
        self.start, self.size = np.arange(len(special), dtype=np.int64), np.ones(len(special), np.int32)

    def _chunks(self, text: str) -> list:
        if self.v.cut is not None and "<|" in text:
            out: list = []
            for k, piece in enumerate(self.v.cut.split(text)):
                out += [(self.v.special[piece], "special")] if k % 2 else self._plain(piece)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list:
        if not text:
            return []
        odd = _SEPARATORS.search(text) is not None
        if self.v.kind == "word":
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return [x for x in _SPACES.split(text) if x] if odd else text.split()
        if odd:
            out = _CUT_FULL.split(text)
        elif _SPACE_RUN.search(text) or text[-1] == " ":
            out = _CUT.split(text)
        else:
            out = text.split(" ")
        out[0] = (out[0], "first")
        return out

    def _split(self, new: list) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The places of the chunks in another order, their pre-tokens one after another in it, and the number for each."""
        word = self.v.kind == "word"
        shown = new if word else [c[0] if isinstance(c, tuple) else " " + c for c in new]
        unusual = _UNUSUAL.search
        odd = [i for i, x in enumerate(shown) if unusual(x)]
        order = np.arange(len(new))
        usual = shown
        if odd:
            plain = np.ones(len(new), bool)
            plain[odd] = False
            order = np.concatenate((order[plain], odd))
            usual = [shown[i] for i in order[: len(new) - len(odd)].tolist()]
        flat = (_WORD_FAST if word else _BYTE_FAST).findall("\0".join(usual))
        cuts = np.array([-1, *(i for i, p in enumerate(flat) if p == "\0"), len(flat)])
        per = np.diff(cuts)[: len(usual)] - 1
        flat = [p for p in flat if p != "\0"]
        rest = [(_WORD_FULL if word else _BYTE_FULL).findall(shown[i]) for i in odd]
        flat += [p for x in rest for p in x]
        return order, flat, np.concatenate((per, np.fromiter(map(len, rest), np.int64, len(rest))))

    def _learn(self, new: list) -> None:
        order, pieces, per = self._split(new)
        own: dict[str, int] = {}
        flat = np.array([own.setdefault(p, len(own)) for p in pieces], np.int64)
        ids, size = self.words.encode([p.encode("utf-8", "surrogatepass") for p in own])
        start = np.cumsum(size, dtype=np.int64) - size
        total = np.concatenate(([0], np.cumsum(size[flat], dtype=np.int64))) if len(flat) else np.zeros(1, np.int64)
        end = np.cumsum(per)
        n = (total[end] - total[end - per]).astype(np.int32)
        begin, length = np.empty(len(new), np.int64), np.empty(len(new), np.int32)
        begin[order], length[order] = len(self.ids) + np.cumsum(n, dtype=np.int64) - n, n
        self.start, self.size = np.concatenate((self.start, begin)), np.concatenate((self.size, length))
        self.ids = np.concatenate((self.ids, ids[gather(flat, start, size)] if len(flat) else ids[:0]))

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chunks = [self._chunks(t) for t in texts]
        if len(self.code) > REMEMBERED:
            self._forget()
        self.code.new.clear()
        per = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(chunks)), np.int64, int(per.sum()))
        if self.code.new:
            self._learn(self.code.new)
        return codes, per

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins (with the end of the last)."""
        codes, per = self._codes(texts)
        return self.ids[gather(codes, self.start, self.size)], self._bounds(codes, per)

    def _bounds(self, codes: np.ndarray, per: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.size[codes], dtype=np.int64)))
        return total[np.concatenate(([0], np.cumsum(per)))]


class PieceCounter(TextEncoder):
    """Counts the tokens of whole texts without their ids.

    ``ids`` holds, for each distinct chunk, the codes of its pre-tokens; ``pieces`` the number of
    pieces of each distinct pre-token, counted when it first appears.
    """

    def _forget(self) -> None:
        super()._forget()
        self.pretoken: dict = {name: k for k, name in enumerate((i, "special") for i in self.v.special.values())}
        self.ids = np.arange(len(self.pretoken), dtype=np.int64)
        self.pieces = np.ones(len(self.pretoken), np.int64)

    def _learn(self, new: list) -> None:
        order, flat, per = self._split(new)
        known = len(self.pretoken)
        codes = np.array([self.pretoken.setdefault(p, len(self.pretoken)) for p in flat], np.int64)
        fresh = [p.encode("utf-8", "surrogatepass") for p in list(self.pretoken)[known:]]
        self.pieces = np.concatenate((self.pieces, self.words.count(fresh)))
        begin, length = np.empty(len(new), np.int64), np.empty(len(new), np.int32)
        begin[order], length[order] = len(self.ids) + np.cumsum(per) - per, per
        self.start, self.size = np.concatenate((self.start, begin)), np.concatenate((self.size, length))
        self.ids = np.concatenate((self.ids, codes))

    def frequencies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (text, pre-token, number of times), one for each distinct pre-token of each text."""
        codes, per = self._codes(texts)
        bound, many = self._bounds(codes, per), max(1, len(self.pieces))
        text = np.repeat(np.arange(len(texts)), np.diff(bound))
        both, times = np.unique(text * many + self.ids[gather(codes, self.start, self.size)], return_counts=True)
        return both // many, both % many, times

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text: its pre-token frequencies joined to the pieces, and summed."""
        text, pretoken, times = self.frequencies(texts)
        return np.bincount(text, weights=times * self.pieces[pretoken], minlength=len(texts)).astype(np.int64)
