"""Cutting texts into units that tokenizers treat independently, and exact BPE merging.

White space here is the Unicode property (the class \\s of the tokenizers' patterns); Python's own \\s also holds
\\x1c-\\x1f, so it is spelled out.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# fixed values: white space, the pre-tokenizer patterns of the two vocabularies, their special strings
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+")
BYTE_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
WORD_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
BYTE_SPECIAL = ("<|endoftext|>",)

_SPACES = re.compile(f"[{WS}]+")
_CUT = re.compile(f"(?=[{WS}][^{WS}])")
_ODD = re.compile(f" [{WS}]|[{WS}]$|[\x1c-\x1f]")
_CONTROL = re.compile("[\x1c-\x1f]")


def word_units(text: str) -> list[str]:
    """Pieces between white space."""
    if _CONTROL.search(text):
        return [x for x in _SPACES.split(text) if x]
    return text.split()


def byte_units(text: str) -> list[str]:
    """Pieces that begin with a white-space character followed by none: no token of the byte-level pattern crosses such
    a place, and what a pattern looks ahead for is alike on either side of it."""
    if not text:
        return []
    if _ODD.search(text) or "\0" in text:
        return [x for x in _CUT.split(text) if x]
    return text.replace(" ", "\0 ").lstrip("\0").split("\0")


def fine_units(text: str) -> list[str]:
    """As :func:`byte_units`, cut at every such place."""
    return [x for x in _CUT.split(text) if x]


def special_parts(text: str, special: tuple[str, ...]) -> list[str]:
    """The text cut at special strings, which stand at the odd places."""
    return re.split("(" + "|".join(map(re.escape, special)) + ")", text)


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others are numbered from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Bpe:
    """A BPE vocabulary with exact merging: of all adjacent pairs the one of least rank, leftmost first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in held["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): i for i, (a, b, _) in enumerate(merges)}
        self.made = [c for _, _, c in merges]  # by rank
        letters = byte_letters()
        self.inner = [self.vocab.get(x, -1) for x in letters]
        self.last = [self.vocab.get(x + self.suffix, -1) for x in letters]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if not piece:
            return []
        ids = [self.inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        return self._short(ids) if len(ids) <= 48 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get, made, none = self.rank.get, self.made, len(self.made)
        found = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            at = found.index(best)
            new = ids[at] = made[best]
            del ids[at + 1], found[at]
            if at:
                found[at - 1] = get((ids[at - 1], new), none)
            if at < len(found):
                found[at] = get((new, ids[at + 1]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[best], -2, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := rank.get((ids[left], ids[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[after[left]]))
        return [x for x in ids if x != -2]


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def lowered(text: str) -> str:
    """Lower case letter by letter, so that no letter depends on its neighbours (Python's final sigma does)."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def word_pretokens(unit: str) -> list[bytes]:
    return [x.encode() for x in WORD_PATTERN.findall(lowered(unicodedata.normalize("NFC", unit)))]


class Memo(dict):
    """unit -> value, made when first asked for. Two generations of ``most`` units at most bound a worker's memory: what is
    asked for again moves to the younger one, the rest is forgotten with the older one."""

    def __init__(self, make: Callable[[str], object], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, unit: str):
        value = self.older.get(unit)
        if value is None:
            value = self.make(unit)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[unit] = value
        return value


class UnitIds:
    """Ids of many texts at once. Arrow cuts the texts into units and numbers the distinct ones; ``make`` gives the ids of
    units that are new (flat ids and the count of each unit), and one gather lays out the ids of all texts. The ``most``
    units that most batches hold stay known, which bounds a worker's memory. ``whole`` gives the ids of texts with special
    strings, which are not cut. With ``apart`` units of words are cut between letters and signs as well (:func:`set_apart`)."""

    def __init__(self, make: Callable, whole: Callable, words: bool, most: int = 500_000, apart: bool = False):
        self.make, self.whole, self.words, self.most, self.apart = make, whole, words, most, apart
        self.number: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.seen = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    @staticmethod
    def _room(values: np.ndarray, n: int) -> np.ndarray:
        return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])

    def _hold(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append units to the pool; returns the number of the first."""
        first, n = len(self.number), len(sizes)
        self.pool = self._room(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at, self.size, self.seen = (self._room(x, first + n) for x in (self.at, self.size, self.seen))
        self.at[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.seen[first : first + n] = 0
        self.used += len(ids)
        return first

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.seen[: len(self.number)], kind="stable")[: self.most // 2])
        names = list(self.number)
        ids = self.pool[spread(self.at[kept], self.size[kept])]
        sizes, seen = self.size[kept], self.seen[kept]
        self.number, self.used = {}, 0
        self._hold(ids, sizes)
        self.seen[: len(kept)] = seen
        self.number = {names[k]: i for i, k in enumerate(kept.tolist())}

    def _numbers(self, names: list[str]) -> np.ndarray:
        """The number of each unit of a batch; makes what is new."""
        if len(self.number) > self.most:
            self._forget()
        get = self.number.get
        found = [get(x, -1) for x in names]
        out = np.asarray(found, np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh = [names[i] for i in new.tolist()]
            first = self._hold(*self.make(fresh))
            out[new] = np.arange(first, first + len(new))
            self.number.update(zip(fresh, range(first, first + len(new)), strict=True))
        self.seen[out] += 1
        return out

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(place of each unit among the distinct ones, first unit of each text and the end, distinct units)."""
        held = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(held, pattern="[\x1c-\x1f]" if self.words else f"[\x1c-\x1f]| {_RE2_WS}|{_RE2_WS}$").to_numpy(zero_copy_only=False)
        if self.words:
            held = pc.if_else(pa.array(odd), "", held) if odd.any() else held
            cut = pc.utf8_split_whitespace(set_apart(held) if self.apart else held)
        else:
            cut = pc.split_pattern(pc.if_else(pa.array(odd), "", held) if odd.any() else held, pattern=" ")
        first = np.asarray(cut.offsets, np.int64)
        coded = cut.flatten().dictionary_encode()
        place, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        # no piece has a space, so one join and one split turn them into Python strings
        whole = pa.ListArray.from_arrays([0, len(distinct)], distinct)
        names = pc.binary_join(whole, " ")[0].as_py().split(" ") if len(distinct) else []
        empty = names.index("") if "" in names else -1
        keep = place != empty
        if not self.words:  # all but the first piece of a text have the space before them
            spaced = np.ones(len(place), bool)
            spaced[first[:-1][np.diff(first) > 0]] = False
            keep |= spaced
            place = 2 * place + spaced
        # the number of units before each piece that stays gives the first unit of each text
        place, starts = place[keep], np.concatenate([[0], np.cumsum(keep)])[first]
        used = np.flatnonzero(np.bincount(place, minlength=1))
        dense = np.zeros(int(used[-1]) + 1 if len(used) else 0, np.int64)
        dense[used] = np.arange(len(used))
        place = dense[place]
        names = [names[i] for i in used.tolist()] if self.words else [" " + names[i >> 1] if i & 1 else names[i >> 1] for i in used.tolist()]
        if odd.any():
            known = {n: i for i, n in enumerate(names)}
            more, whose = [], []
            for i in np.flatnonzero(odd).tolist():
                for unit in (word_units if self.words else byte_units)(texts[i]):
                    more.append(known.setdefault(unit, len(known)))
                    whose.append(i)
            owner = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(starts)), np.asarray(whose, np.int64)])
            order = np.argsort(owner, kind="stable")
            place, names = np.concatenate([place, np.asarray(more, np.int64)])[order], list(known)
            starts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
        return place, starts, names

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        whole = [i for i, t in enumerate(texts) if "<|" in t]
        place, first, names = self.units(["" if "<|" in t else t for t in texts] if whole else texts)
        unit = self._numbers(names)[place] if len(names) else place
        sizes = self.size[unit]
        ids = self.pool[spread(self.at[unit], sizes)]
        starts = np.concatenate([[0], np.cumsum(sizes)])[first]
        if not whole:
            return ids, starts
        parts = np.split(ids, starts[1:-1])
        for i in whole:
            parts[i] = self.whole(texts[i])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


#: Letters, signs and the apostrophe of ASCII; between which two of them the pattern of words always cuts: a letter and what is
#: no letter, a sign and a letter (an apostrophe and letters may be one piece).
_SIDE = np.zeros(256, np.uint8)
_SIDE[33:127] = 2
_SIDE[48:58], _SIDE[65:91], _SIDE[97:123], _SIDE[39] = 0, 1, 1, 3
_CUTS = np.zeros(16, bool)
_CUTS[[1 * 4 + 2, 1 * 4 + 3, 2 * 4 + 1]] = True


def set_apart(texts: pa.StringArray) -> pa.StringArray:
    """The texts with a space wherever ``_CUTS`` says, which changes no id of the vocabulary of words and leaves fewer units:
    a word is one unit whatever signs are beside it."""
    _, offsets, held = texts.buffers()
    if held is None or not len(texts):
        return texts
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(held, np.uint8)[: offsets[-1]]
    side = _SIDE[raw]
    at = np.flatnonzero(_CUTS[(side[:-1] << 2) + side[1:]]) + 1
    offsets += np.searchsorted(at, offsets)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.insert(raw, at, 32)))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (sizes[i] of them) for all i, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


#: White space of WS in the spelling of Arrow's regular expressions.
_RE2_WS = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


#: Units of few kinds of letters, for which it is plain where pre-tokens end: without apostrophes (words), or beginning with
#: their one space and a letter (bytes), so that no other token of theirs begins with a space.
_PLAIN_WORD = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PLAIN_BYTE = re.compile(f" [^{WS}][^ ]*")
_KIND = np.full(256, 1, np.int8)  # letters, the bytes of letters beyond ASCII among them
_KIND[33:65], _KIND[91:97], _KIND[123:127], _KIND[48:58], _KIND[32] = 2, 2, 2, 3, 0


def pretokens(units: str) -> np.ndarray:
    """The number of pre-tokens, by the pattern of words, of each of some plain units with a space between them: runs of letters,
    single digits and runs of other characters."""
    kind = _KIND[np.frombuffer(f"{units} ".encode(), np.uint8)]
    begins = (kind > 0) & ((np.diff(kind, prepend=np.int8(0)) != 0) | (kind == 3))
    ends = np.flatnonzero(kind == 0)
    return np.diff(np.cumsum(begins)[ends], prepend=0)


@lru_cache(maxsize=2)
def library_units(path: str, words: bool) -> UnitIds:
    """Ids by the tokenizers library, which encodes each new unit once, many in one string. Plain units stand side by side as in
    a text, and their ids are told apart by the tokens; between others there is a special string."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    mark = (WORD_SPECIAL if words else BYTE_SPECIAL)[-1]
    mark_id = library.token_to_id(mark)
    vocab = library.get_vocab()
    #: Of each token: whether a pre-token ends in it (words), or a space is its first character.
    edge = np.zeros(max(vocab.values()) + 1, bool)
    edge[[i for t, i in vocab.items() if (t.endswith("</w>") if words else t[0] == "Ġ")]] = True
    plain = (_PLAIN_WORD if words else _PLAIN_BYTE).fullmatch

    def flat(joined: list[str]) -> np.ndarray:
        held = library.encode_batch_fast(joined, add_special_tokens=False)
        return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(x.ids, np.uint32) for x in held)])

    def marked(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = flat([mark.join(units[i : i + 16]) + mark for i in range(0, len(units), 16)])
        ends = np.flatnonzero(ids == mark_id)
        return ids[ids != mark_id], np.diff(ends, prepend=-1) - 1

    def joined(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain units keep apart by themselves: no mark is needed between them."""
        by = " " if words else ""
        parts = [by.join(units[i : i + 64]) for i in range(0, len(units), 64)]
        ids = flat(parts)
        if words:
            last = np.cumsum(pretokens(by.join(parts)))
            ends = np.flatnonzero(edge[ids])[last - 1]
        else:
            ends = np.append(np.flatnonzero(edge[ids])[1:] - 1, len(ids) - 1)
        return ids, np.diff(ends, prepend=-1)

    def make(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        easy = np.fromiter((plain(u) is not None for u in units), bool, len(units))
        if not easy.any():
            return marked(units)
        ids, sizes = joined([units[i] for i in np.flatnonzero(easy).tolist()])
        if easy.all():
            return ids, sizes
        more, n = marked([units[i] for i in np.flatnonzero(~easy).tolist()])
        order = np.argsort(np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)]))
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, n])
        return ids[spread((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]

    def whole(text: str) -> np.ndarray:
        return np.asarray(library.encode(text, add_special_tokens=False).ids, np.uint32)

    return UnitIds(make, whole, words, apart=words)
