"""Byte-level BPE over whole texts: cutting into pieces, token ids of pieces, and a counting transducer.

A byte-level BPE tokenizer first cuts a text by a fixed pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` and then merges inside each piece.
``piece_starts`` finds the cuts of a whole chunk with array operations; ``CutTransducer`` finds the same cuts as a
finite-state transducer whose chunk state maps compose by a prefix scan, and so do those of ``CountTransducer``, which counts tokens.
``PieceTable`` looks distinct pieces up in a table of bounded size in each worker, so a frequent piece is merged once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np

from . import textbytes as tb

# The code points with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
L, N, O, SP, W, EDGE = range(6)

_loaded: dict[str, tuple[str, object]] = {}


def loaded(name: str, make: Callable[[], object], version: str = ""):
    """Made once in each worker; of several versions (a file, or a digest of what was learned) the last is kept."""
    if name not in _loaded or _loaded[name][0] != version:
        _loaded[name] = version, make()
    return _loaded[name][1]


def checked(path: str) -> str:
    """``path``, if its tokenizer is of the kind that is compiled here: byte-level BPE, cut by the fixed pattern, without normalizer or prefix space. Any other file is an error."""
    file = json.load(open(path, encoding="utf-8"))
    model, cut = file.get("model") or {}, file.get("pre_tokenizer") or {}
    wrong = [name for name in ("normalizer", "truncation", "padding") if file.get(name)]
    wrong += [f"model.{name}" for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(name)]
    wrong += ["model.type"] if model.get("type", "BPE") != "BPE" else []
    wrong += ["pre_tokenizer"] if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) else []
    if wrong:
        raise ValueError(f"{path} is no plain byte-level BPE: {', '.join(wrong)} not supported")
    return path


def special_strings(path: str) -> list[bytes]:
    """The added tokens of a tokenizer file, which the library takes whole wherever they stand."""
    added = json.load(open(path, encoding="utf-8")).get("added_tokens") or []
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what is around them are not supported")
    return sorted((t["content"].encode() for t in added if t["content"]), key=len, reverse=True)


def special_pattern(path: str) -> re.Pattern[bytes] | None:
    """Finds special strings, the longest where several begin."""
    found = special_strings(path)
    return re.compile(b"|".join(map(re.escape, found))) if found else None


def _char_classes() -> np.ndarray:
    kinds = np.fromiter(({"L": L, "N": N}.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), np.uint8, 0x110000)
    kinds[WHITE_SPACE] = W
    kinds[0x20] = SP
    return kinds


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code point of each character of valid UTF-8, and the byte at which it starts."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    first = raw[at]
    code = first.astype(np.int32)
    for low, high, size, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0xF8, 4, 0x07)):
        some = np.flatnonzero((first >= low) & (first < high))
        if len(some):
            x = first[some].astype(np.int32) & mask
            for k in range(1, size):
                x = (x << 6) | (raw[np.minimum(at[some] + k, len(raw) - 1)] & 0x3F)
            code[some] = np.minimum(x, 0x10FFFF)
    return code, at


def _shifted(x: np.ndarray, by: int, edges: np.ndarray, fill: int) -> np.ndarray:
    """x[i + by], with ``fill`` across the borders between texts (edges: the first characters of texts)."""
    out = np.full(len(x), fill, x.dtype)
    if by < 0:
        out[-by:] = x[:by]
        for k in range(-by):
            i = edges + k
            out[i[i < len(x)]] = fill
    else:
        out[:-by] = x[by:]
        for k in range(1, by + 1):
            i = edges - k
            out[i[i >= 0]] = fill
    return out


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes at which pieces start; the pattern decides each cut from one character before and two after."""
    if not len(raw):
        return np.zeros(0, np.int64)
    code, at = code_points(raw)
    kind = loaded("classes", _char_classes)[code]
    edges = np.unique(np.searchsorted(at, offsets[:-1][offsets[:-1] < len(raw)]))
    prev, following = _shifted(kind, -1, edges, EDGE), _shifted(kind, 1, edges, EDGE)
    space = kind >= SP
    start = np.where(space, (prev < SP) | (prev == EDGE) | (following < SP), (prev == EDGE) | (prev == W) | ((prev < SP) & (prev != kind)))
    quotes = np.flatnonzero((code == 39) & start)
    if len(quotes):
        one, two = _shifted(code, 1, edges, 0)[quotes], _shifted(code, 2, edges, 0)[quotes]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quotes[short | long] + 1] = False
        for found, size in ((quotes[short], 2), (quotes[long], 3)):
            after = found + size
            after = after[after < len(kind)]
            start[after[kind[after] == L]] = True
    return at[start]


class PieceTable:
    """Values of pieces by hash, in open addressing; emptied when half full, so memory is bounded."""

    def __init__(self, values: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int = 22):
        """values: (for each piece the number of items, all items)."""
        self.values, self.bits = values, bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.size = 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.items, self.filled = np.zeros(1 << 18, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        slot = (hashes & mask).astype(np.int64)
        open_, found = np.arange(len(hashes)), np.full(len(hashes), -1, np.int64)
        while len(open_):
            key = self.keys[slot]
            hit = key == hashes[open_]
            found[open_[hit]] = self.slots[slot[hit]]
            on = ~hit & (key != 0)
            open_, slot = open_[on], (slot[on] + 1) & int(mask)
        return found

    def _insert(self, hashes: np.ndarray, rank: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]  # of several that want one slot, the last gets it
            won = self.keys[slot] == hashes[left]
            self.slots[slot[won]] = rank[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & mask

    def _grown(self, name: str, n: int) -> np.ndarray:
        x = getattr(self, name)
        if n > len(x):
            x = np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])
            setattr(self, name, x)
        return x

    def ranks(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each piece in ``starts`` and ``lengths``."""
        hashes = tb.span_hashes(raw, starts, ends) | np.uint64(1 << 63)
        rank = self._find(hashes)
        if (missing := np.flatnonzero(rank < 0)).size:
            if 2 * (self.size + len(missing)) > 1 << self.bits and self.size:
                self.clear()
                missing = np.arange(len(hashes))
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            if 2 * len(new) > 1 << self.bits:
                self.bits += 2
                self.clear()
            i, j = starts[missing[first]].tolist(), ends[missing[first]].tolist()
            text = raw.tobytes()
            counts, items = self.values([text[a:b] for a, b in zip(i, j, strict=True)])
            n, at = len(new), np.cumsum(counts) - counts
            self._grown("starts", self.size + n)[self.size : self.size + n] = self.filled + at
            self._grown("lengths", self.size + n)[self.size : self.size + n] = counts
            self._grown("items", self.filled + len(items))[self.filled : self.filled + len(items)] = items
            self._insert(new, self.size + np.arange(n))
            rank[missing] = self.size + back
            self.size, self.filled = self.size + n, self.filled + len(items)
        return rank


def gathered(items: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of items[s : s + n] over all spans."""
    ends = np.cumsum(lengths)
    steps = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    return items[steps]


def byte_chars() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*printable}))}


def library_ids(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Token ids of pieces as the ``tokenizers`` library gives them."""
    from tokenizers import Tokenizer

    model, chars = Tokenizer.from_file(path).model, byte_chars()

    def ids(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [[t.id for t in model.tokenize(p.decode("latin-1").translate(chars))] for p in found]
        return np.fromiter(map(len, each), np.int64, len(each)), np.fromiter((i for x in each for i in x), np.uint32)

    return ids


# ---- the counting transducer


class CutTransducer:
    """The pattern's cuts as a deterministic transducer over character classes.

    A transition may announce a piece that starts at the character just read (1) or at the one before (2). Chunks of
    ``width`` symbols are compiled to maps from entry to exit state; the maps compose by a parallel prefix scan, and then
    all chunks run side by side from their known entry states.
    """

    # states: start of a text, in letters, in digits, in other signs, after a space, after other white space,
    # after an apostrophe that starts a piece, after it and r/v or l, after a finished contraction
    STATES = START, LETTERS, DIGITS, SIGNS, SPACE, WHITE, QUOTE, QUOTE_E, QUOTE_L, DONE = range(10)
    # symbols: other letters, s/t/m/d, r/v, e, l, digits, other signs, apostrophe, space, other white space, end of a text
    SYMBOLS = OTHER, STMD, RV, LET_E, LET_L, DIGIT, SIGN, APOSTROPHE, BLANK, GAP, END = range(11)

    def __init__(self, width: int = 128):
        self.width = width
        self.table = np.zeros((len(self.SYMBOLS), len(self.STATES)), np.uint8)
        for symbol in self.SYMBOLS:
            for state in self.STATES:
                to, cut = self._step(state, symbol)
                self.table[symbol, state] = to << 2 | cut
        self.symbols = np.array([self.OTHER, self.DIGIT, self.SIGN, self.BLANK, self.GAP], np.uint8)[loaded("classes", _char_classes)]
        for symbol, letters in ((self.STMD, "stmd"), (self.RV, "rv"), (self.LET_E, "e"), (self.LET_L, "l"), (self.APOSTROPHE, "'")):
            self.symbols[[ord(c) for c in letters]] = symbol

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        letter, white = symbol <= self.LET_L, symbol in (self.BLANK, self.GAP)
        to = self.LETTERS if letter else {self.DIGIT: self.DIGITS, self.SIGN: self.SIGNS, self.APOSTROPHE: self.QUOTE, self.BLANK: self.SPACE, self.GAP: self.WHITE, self.END: self.START}[symbol]
        if symbol == self.END:
            return self.START, 2 if state in (self.QUOTE_E, self.QUOTE_L) else 0
        if state == self.SPACE:
            return (to, 0) if white else (self.SIGNS if symbol == self.APOSTROPHE else to, 2)
        if state == self.WHITE:
            return (to, 0) if white else (to, 3)
        if state == self.LETTERS:
            return to, 0 if letter else 1
        if state == self.DIGITS:
            return to, 0 if symbol == self.DIGIT else 1
        if state == self.SIGNS:
            return (self.SIGNS, 0) if symbol in (self.SIGN, self.APOSTROPHE) else (to, 1)
        if state == self.QUOTE:
            if symbol == self.STMD:
                return self.DONE, 0
            if symbol in (self.RV, self.LET_L):
                return (self.QUOTE_E if symbol == self.RV else self.QUOTE_L), 0
            return (self.SIGNS, 0) if symbol in (self.SIGN, self.APOSTROPHE) else (to, 1)
        if (state, symbol) in ((self.QUOTE_E, self.LET_E), (self.QUOTE_L, self.LET_L)):
            return self.DONE, 0
        if state in (self.QUOTE_E, self.QUOTE_L):
            return to, 2 | (0 if letter else 1)
        return to, 1  # after a contraction, and at the start of a text

    def starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The bytes at which pieces start."""
        if not len(raw):
            return np.zeros(0, np.int64)
        code, at = code_points(raw)
        ends = np.searchsorted(at, offsets[1:])
        symbols = np.insert(self.symbols[code], ends, self.END)  # each text is closed by an END
        place = np.insert(at, ends, -1)
        n = -len(symbols) % self.width
        grid = np.concatenate([symbols, np.full(n, self.END, np.uint8)]).reshape(-1, self.width)
        to, states = self.table >> 2, len(self.STATES)
        maps = np.broadcast_to(np.arange(states, dtype=np.intp), (len(grid), states))
        flat = to.ravel().astype(np.intp)
        base = grid.astype(np.intp) * states
        for k in range(self.width):
            maps = flat.take(base[:, k, None] + maps)
        step = 1
        while step < len(maps):  # maps[i] becomes the map of chunks 0..i
            maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)])
            step *= 2
        state = np.concatenate([[self.START], maps[:-1, self.START]])
        cut, packed = np.empty(grid.shape, np.uint8), self.table.ravel()
        for k in range(self.width):
            x = packed.take(base[:, k] + state)
            cut[:, k] = x & 3
            state = (x >> 2).astype(np.intp)
        cut = cut.ravel()
        start = (cut & 1).astype(bool)[: len(symbols)]
        before = np.flatnonzero(cut & 2) - 1
        start[before[before >= 0]] = True
        return place[start & (place >= 0)]


class CountTransducer:
    """Byte-level BPE as a deterministic transducer over bytes: each transition is annotated with the tokens that it adds (or, by a merge, takes back).

    A BPE encoding is right exactly when each pair of neighbouring tokens is the encoding of its own bytes, so the last token after a byte is the
    longest suffix that is a token and agrees with the last token before it. A state therefore holds, for each suffix of what was read that may begin
    a longer token, the last token before the suffix and how many tokens ended by then, counted from now; different pieces with the same such
    suffixes share a state. Transitions are compiled to a table as they come up; beyond ``most`` states the table starts over, so memory is bounded.

    The first byte of a piece leads every state to the same next one. So the map of a chunk of ``width`` bytes in which a piece starts is constant but
    for its count before that start, and the maps compose in a prefix scan in which constant ones absorb all before them. All chunks run side by side.
    """

    UNKNOWN, START = 0, 1
    ROWS = 4096  # chunks that run at a time

    def __init__(self, path: str, width: int = 64, most: int = 300_000):
        model = json.load(open(path, encoding="utf-8"))["model"]
        byte = {c: b for b, c in byte_chars().items()}
        raw = lambda s: bytes(byte[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.tokens = {raw(t): k for t, k in model["vocab"].items() if all(c in byte for c in t)}
        self.begins = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.merge: dict[tuple[int, int], int] = {}
        self.made = dict.fromkeys(self.tokens.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, both = self.tokens[raw(a)], self.tokens[raw(b)], self.tokens[raw(a) + raw(b)]
            self.merge[left, right] = rank
            self.made[both], self.parts[both] = rank, (left, right)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.width, self.most = width, most
        self._clear()

    def _agree(self, a: int, b: int) -> bool:
        """Whether no merge across the border of two tokens comes before the merges that made them.

        The merges are taken back from the last to the first; of equal merges the left one came first.
        """
        if (known := self.pairs.get((a, b))) is not None:
            return known
        key, limit, good = (a, b), 1 << 60, True
        while good:
            if self.merge.get((a, b), 1 << 61) < limit:
                good = False
            elif self.made[a] > self.made[b]:
                limit, a = self.made[a], self.parts[a][1]
            elif self.made[b] >= 0:
                limit, b = self.made[b] + 1, self.parts[b][0]
            else:
                break
        if len(self.pairs) >= 1_000_000:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def _clear(self) -> None:
        self.states: list[tuple[bytes, tuple[tuple[int, int, int], ...]] | None] = []
        self.numbers: dict = {}
        # transitions by state << 8 | byte, in open addressing; the entry is the next state << 8 | 128 more than the change of the number of tokens
        self.keys, self.entries, self.filled = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int32), 0
        self.alone: dict[int, int] = {}
        self._number(None)
        self._number((b"", ((0, -1, 0),)))  # (length of the suffix, last token before it, tokens by then), longest first

    def _number(self, state) -> int:
        n = self.numbers.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n

    def _compile(self, key: int) -> int:
        """The entry of a transition."""
        if key >> 8 == self.UNKNOWN:
            return self.UNKNOWN << 8 | 128
        text, suffixes = self.states[key >> 8]
        text += bytes([key & 255])
        for size, last, count in suffixes:
            token = self.tokens.get(text[len(text) - 1 - size :])
            if token is not None and (last < 0 or self._agree(last, token)):
                change = count + 1
                break
        else:
            raise ValueError(f"no token ends with {text!r}")
        kept = [(size + 1, last, count - change) for size, last, count in suffixes if text[len(text) - 1 - size :] in self.begins]
        to = self._number((text[len(text) - kept[0][0] :] if kept else b"", (*kept, (0, token, 0))))
        if not -128 <= change <= 127:
            raise ValueError(f"a step changes the count by {change}, more than a byte holds")
        return to << 8 | (change + 128)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of transitions, -1 for those not yet compiled."""
        slot, mask = self._slot(keys), len(self.keys) - 1
        there = self.keys[slot]
        found = np.where(there == keys, self.entries[slot], -1)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & mask
            there = self.keys[slot[on]]
            hit = there == keys[on]
            found[on[hit]] = self.entries[slot[on[hit]]]
            on = on[~hit & (there >= 0)]
        return found

    def _store(self, keys: np.ndarray, entries: np.ndarray) -> None:
        if 2 * (self.filled + len(keys)) > len(self.keys):
            old, values = self.keys, self.entries
            size = 2 * len(old)
            while 2 * (self.filled + len(keys)) > size:
                size *= 2
            self.keys, self.entries, self.filled = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0
            self._store(old[old >= 0], values[old >= 0])
        slot, left, mask = self._slot(keys), np.arange(len(keys)), len(self.keys) - 1
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several that want one slot, the last gets it
            won = self.keys[slot] == keys[left]
            self.entries[slot[won]] = entries[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & mask
        self.filled += len(keys)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state << 8 | byte
        found = self._find(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            self._store(new, np.fromiter(map(self._compile, new.tolist()), np.int32, len(new)))
            found = self._find(keys)
        return (found >> 8).astype(np.int64), (found & 255).astype(np.int16) - 128

    def _run(self, grid: np.ndarray, starts: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """(changes by byte, state at the end) of chunks, a row each, from the state before the first."""
        out, width = np.zeros(grid.shape, np.int16), grid.shape[1]
        state = np.full(len(grid), self.UNKNOWN, np.int64)
        state[0] = entry
        for k in range(width):
            state, out[:, k] = self._step(np.where(starts[:, k], self.START, state), grid[:, k])
        lead = np.where(starts.any(1), starts.argmax(1), width)
        lead[0] = 0
        # the chunks behind a constant map know their entry: what lies before their first start runs side by side
        ready = np.flatnonzero(lead[1:] > 0) + 1
        behind = ready[state[ready - 1] == self.UNKNOWN]
        ready = ready[state[ready - 1] != self.UNKNOWN]
        ready = ready[np.argsort(-lead[ready], kind="stable")]
        now, depth = state[ready - 1], -lead[ready]
        for k in range(int(lead[ready].max()) if len(ready) else 0):
            n = int(np.searchsorted(depth, -k, "left"))
            now[:n], out[ready[:n], k] = self._step(now[:n], grid[ready[:n], k])
        whole = lead[ready] == width
        state[ready[whole]] = now[whole]
        # and a piece that is longer than a chunk runs through one after the other
        for r in behind.tolist():
            s, changes = int(state[r - 1]), []
            for byte in grid[r, : lead[r]].tolist():
                x = self.alone.get(s << 8 | byte)
                if x is None:
                    x = self.alone[s << 8 | byte] = self._compile(s << 8 | byte)
                s = x >> 8
                changes.append((x & 255) - 128)
            out[r, : lead[r]] = changes
            if lead[r] == width:
                state[r] = s
        return out, int(state[-1])

    def totals(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of tokens up to each byte, from 0 on; ``starts`` are the bytes at which pieces start, 0 among them."""
        n = len(raw)
        rows = -(-n // self.width)
        grid, mark = np.zeros(rows * self.width, np.uint8), np.ones(rows * self.width, bool)
        grid[:n], mark[:n] = raw, False
        mark[starts] = True
        grid, mark = grid.reshape(rows, self.width), mark.reshape(rows, self.width)
        total, entry = np.zeros(n + 1, np.int64), self.START
        change = np.zeros(grid.shape, np.int16)
        for a in range(0, rows, self.ROWS):
            change[a : a + self.ROWS], entry = self._run(grid[a : a + self.ROWS], mark[a : a + self.ROWS], entry)
            if len(self.states) > self.most:
                state = self.states[entry]
                self._clear()
                entry = self._number(state)
        np.cumsum(change.ravel()[:n], out=total[1:])
        return total

    def count(self, piece: bytes) -> int:
        return int(self.totals(np.frombuffer(piece, np.uint8), np.array([0]))[-1]) if piece else 0
