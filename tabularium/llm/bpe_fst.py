"""Byte-level BPE as compiled finite-state transducers.

Two deterministic machines read a text:

1. A pre-token machine over character classes. Blocks of text are cut into chunks of CHUNK characters; each chunk's
   effect is its state map (state before -> state after). Maps compose associatively, so a parallel prefix scan over the
   chunks gives the state every chunk begins in, and a second pass marks the character that begins each pre-token.
2. A token machine over bytes, reset at each pre-token. Its state holds the vocabulary prefixes still open and the last
   token before each; a transition is annotated with the change in the number of tokens emitted, and with the token
   that now ends the text. Transitions are compiled when first met, into a hash table of bounded size.

Within a pre-token the BPE encoding of every prefix extends that of a shorter one by one token, and the encoding is the
only sequence whose neighbours all are stable pairs; so the last token at each byte is the one open prefix that is a
token and stable beside the token before it.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np

#: Characters of a chunk of the pre-token machine, bytes of a run of the token machine and of a pass over it, compiled transitions kept.
CHUNK, RUN, STRIDE, MAX_EDGES = 128, 1024, 64, 1_200_000
#: Bytes of texts whose pre-tokens are found together.
PART = 1 << 20
#: Results of stability tests kept.
MOST_STABLE = 100_000
_OPEN = struct.Struct("<iii")

# Character classes of the pre-token machine: letter, number, other, space, other white space; apostrophes that open a
# contraction of one or two letters count apart, as do white-space characters that are followed by a non-white one.
LETTER, NUMBER, OTHER, SPACE_LAST, SPACE_MORE, WHITE_LAST, WHITE_MORE, SHORT, LONG, BREAK = range(10)
# States: what the last character was; IN_SPACE may lend its space to what follows; TAIL counts down a contraction.
AT_START, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, IN_WHITE, TAIL_2, TAIL_1, TAIL_0 = range(9)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token begins) by [class, state]."""
    step, begins = np.zeros((10, 9), np.uint8), np.zeros((10, 9), bool)
    for s in range(9):
        for c in range(10):
            if s == TAIL_2 or s == TAIL_1:
                to, new = s + 1, False
            elif c in (LETTER, NUMBER, OTHER):
                to = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER}[c]
                new = s not in (to, IN_SPACE)
            elif c in (SHORT, LONG):  # a contraction only where a pre-token may begin
                inside = s in (IN_OTHER, IN_SPACE)
                to, new = (IN_OTHER, False) if inside else (TAIL_1 if c == SHORT else TAIL_2, True)
            elif c in (SPACE_LAST, WHITE_LAST):  # the last of a run stands alone or joins what follows
                to, new = (IN_SPACE if c == SPACE_LAST else IN_WHITE), True
            else:  # an inner or final character of a run of white space
                to, new = IN_WHITE, s != IN_WHITE
            if c == BREAK:
                to, new = AT_START, True
            step[c, s], begins[c, s] = to, new
    # After a white-space character that stood alone (a run's last), nothing is lent unless it was a space.
    return step, begins


STEP, BEGINS = _machine()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class by code point, from the pattern's own categories: letters, numbers, white space and the rest."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE_MORE)):
        for m in regex.finditer(pattern, every):
            for k in range(2):  # a match may span the gap of the surrogates
                a, b = m.start(), m.end()
                a, b = (a, min(b, 0xD800)) if k == 0 else (max(a, 0xD800) + 0x800, b + 0x800)
                if a < b:
                    out[a:b] = kind
    out[32] = SPACE_MORE
    return out


def boundaries(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """For code points, whether each begins a pre-token. breaks: positions (sorted) where a separate text begins."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[points]
    white = (kind == WHITE_MORE) | (kind == SPACE_MORE)
    last_of_text = np.zeros(n, bool)
    last_of_text[breaks[1:][breaks[1:] > 0] - 1] = True
    last_of_text[-1] = True
    ends = white.copy()
    ends[:-1] &= ~white[1:]
    ends &= ~last_of_text
    kind[ends] -= 1  # *_MORE to *_LAST
    # Apostrophes: the one or two letters after them within the text decide.
    at = np.flatnonzero(points == 39)
    if len(at):
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = pad[at + 1], pad[at + 2]
        stop = np.concatenate([last_of_text, np.ones(2, bool)])
        has_one, has_two = ~stop[at], ~stop[at] & ~stop[at + 1]
        short = has_one & np.isin(one, [ord(x) for x in "stmd"])
        long = has_two & np.isin(one.astype(np.int64) * 0x200000 + two, [ord(a) * 0x200000 + ord(b) for a, b in ("re", "ve", "ll")])
        kind[at[short]], kind[at[long]] = SHORT, LONG
    # A text's first character is read in AT_START: the state before it is set by a break class in between.
    first = np.zeros(n, bool)
    first[breaks[breaks < n]] = True
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, BREAK, np.uint8)
    padded[:n] = kind
    begin = np.zeros(rows * CHUNK, bool)
    begin[:n] = first
    grid, firsts = padded.reshape(rows, CHUNK).T.copy(), begin.reshape(rows, CHUNK).T.copy()
    flat = STEP.ravel()
    # Chunk state maps: all states run through the chunk together.
    states = np.tile(np.arange(9, dtype=np.uint8), (rows, 1))
    for c, f in zip(grid, firsts, strict=True):
        if f.any():
            states[f] = AT_START
        states = flat[c[:, None].astype(np.intp) * 9 + states]
    # Parallel prefix scan: maps[i] becomes the composition of chunks 0..i.
    maps, hop = states.astype(np.intp), 1
    while hop < rows:
        later = maps.copy()
        later[hop:] = np.take_along_axis(maps[hop:], maps[:-hop], 1)
        maps, hop = later, hop * 2
    state = np.zeros(rows, np.intp)
    state[1:] = maps[:-1, AT_START]
    out = np.zeros((CHUNK, rows), bool)
    new = BEGINS.ravel()
    for k, (c, f) in enumerate(zip(grid, firsts, strict=True)):
        state[f] = AT_START
        index = c.astype(np.intp) * 9 + state
        out[k] = new[index] | f
        state = flat[index].astype(np.intp)
    return out.T.ravel()[:n]


def _begins(body: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For bytes of UTF-8 texts that begin at firsts, whether each begins a pre-token. Whole texts of about PART bytes are looked at together."""
    begins = np.zeros(len(body), bool)
    low = 0
    while low < len(firsts):
        high = max(low + 1, int(np.searchsorted(firsts, firsts[low] + PART)))
        a, b = int(firsts[low]), int(firsts[high]) if high < len(firsts) else len(body)
        part = body[a:b]
        points = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        begins[a:b][lead[boundaries(points, np.searchsorted(lead, firsts[low:high] - a))]] = True
        low = high
    return begins


class Transducer:
    """The token machine of one vocabulary. size bounds the compiled transitions; beyond it they are compiled anew."""

    def __init__(self, path: str, size: int = MAX_EDGES) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        vocab = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # Ordinals: bytes first, then merges by rank, so that a smaller ordinal merges earlier.
        self.ordinal, self.left, self.right, self.merged = {bytes([b]): b for b in range(256)}, [*range(256)], [*range(256)], {}
        for a, b in merges:
            left, right = (bytes(byte_of[c] for c in x) for x in (a, b))
            k = len(self.left)
            if left + right in self.ordinal:
                continue
            self.ordinal[left + right] = k
            self.left.append(self.ordinal[left])
            self.right.append(self.ordinal[right])
            self.merged[self.ordinal[left], self.ordinal[right]] = k
        words = sorted(self.ordinal, key=self.ordinal.get)
        self.length = np.array([len(w) for w in words], np.int64)
        self.id = np.array([vocab[w] for w in words], np.int64)
        # Vocabulary trie: (node, byte) -> node, and the token that ends in a node.
        self.child: dict[int, int] = {}
        self.token = [-1]
        for w, k in self.ordinal.items():
            node = 0
            for b in w:
                to = self.child.get(node << 8 | b)
                if to is None:
                    to = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = k
        self.stable: dict[int, bool] = {}
        self.bits = max(10, int(size * 4 // 3).bit_length())
        self.size = size
        self._clear()

    def _clear(self, live: np.ndarray | None = None) -> np.ndarray | None:
        """Forget all transitions and all states but those in live, whose new numbers are returned."""
        kept = [self.states[k] for k in live.tolist()] if live is not None else []
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        self.delta = np.zeros(1 << self.bits, np.int16)
        self.last = np.zeros(1 << self.bits, np.int32)
        # A state is the open prefixes, the longest first, each as (trie node, token before it, tokens more than the last state's).
        start = _OPEN.pack(0, -1, 0)
        self.state_of: dict[bytes, int] = {start: 0}
        self.states: list[bytes] = [start]
        self.edges = 0
        return np.array([self._number(s) for s in kept], np.int64) if live is not None else None

    def _number(self, state: bytes) -> int:
        number = self.state_of.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _is_stable(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a, b side by side: undo merges from the later one on and look for a merge across."""
        if a < 0:
            return True
        pair = a << 32 | b
        found = self.stable.get(pair)
        if found is not None:
            return found
        if len(self.stable) > MOST_STABLE:
            self.stable.clear()
        x, y, bound, ok = a, b, len(self.left), True
        while True:
            over = self.merged.get((x, y))
            if over is not None and over < bound:
                ok = False
                break
            x_leaf, y_leaf = x < 256, y < 256
            if x_leaf and y_leaf:
                break
            if x > y:  # the left token was made last; merges across need a smaller rank than its
                bound, x = x, self.right[x]
            else:  # equal or later on the right: a merge across of the same rank comes first, being further left
                bound, y = y + 1, self.left[y]
        self.stable[pair] = ok
        return ok

    def _compile(self, keys: list[int]) -> None:
        child, tokens, shift, mask = self.child, self.token, 64 - self.bits, (1 << self.bits) - 1
        table = self.key
        for key in keys:
            state, byte = key >> 8, key & 255
            opened = [(to, before, count) for node, before, count in _OPEN.iter_unpack(self.states[state]) if (to := child.get(node << 8 | byte)) is not None]
            for node, before, count in opened:
                token = tokens[node]
                if token >= 0 and self._is_stable(before, token):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            delta = count + 1
            number = self._number(b"".join([_OPEN.pack(to, before, count - delta) for to, before, count in opened]) + _OPEN.pack(0, token, 0))
            slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> shift
            while table[slot] >= 0:
                slot = (slot + 1) & mask
            table[slot] = key
            self.to[slot], self.delta[slot], self.last[slot] = number, delta, token
        self.edges += len(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of transitions, -1 for those not yet compiled."""
        slot = self._slot(keys)
        got = self.key[slot]
        open_ = np.flatnonzero(got != keys)
        while len(open_):
            empty = got[open_] < 0
            slot[open_[empty]] = -1
            open_ = open_[~empty]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got[open_] = self.key[slot[open_]]
            open_ = open_[got[open_] != keys[open_]]
        return slot

    def _advance(self, state: np.ndarray, byte: np.ndarray, want_last: bool) -> np.ndarray:
        """Read a byte in each state, in place; what each transition is annotated with: the last token if asked, else the change in tokens."""
        note = self.last if want_last else self.delta
        keys = state << 8 | byte
        slot = self._find(keys)
        if not len(slot) or slot.min() >= 0:
            state[:] = self.to[slot]
            return note[slot]
        noted, todo = np.empty(len(keys), np.int64), np.arange(len(keys))
        while len(todo):
            new = np.unique(keys[slot < 0])
            if len(new) > self.size - self.edges and self.edges:
                # No room: all states of this moment, those already ahead too, move to an emptied table.
                live, back = np.unique(state, return_inverse=True)
                state[:] = self._clear(live)[back]
            else:
                self._compile(new[: self.size - self.edges].tolist())
            note = self.last if want_last else self.delta
            keys = state[todo] << 8 | byte[todo]
            slot = self._find(keys)
            known = slot >= 0
            at, found = todo[known], slot[known]
            state[at], noted[at] = self.to[found], note[found]
            todo, keys, slot = todo[~known], keys[~known], slot[~known]
        return noted

    def run(self, data: np.ndarray, begins: np.ndarray, firsts: np.ndarray, want_ids: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Read bytes whose pre-tokens begin where begins is set and whose texts begin at firsts (sorted, non-empty texts).

        Gives for each run of the machine the text it belongs to and its number of tokens (zeros if ids are asked for), and if asked, the
        token ordinal that ends at each byte that ends a token (else -1). A run begins with a pre-token, so its state map is
        constant and composes with the others by adding counts.
        """
        n = len(data)
        marks = np.flatnonzero(begins)
        edges = np.searchsorted(marks, np.arange(0, n, RUN))
        starts = np.unique(np.concatenate([marks[np.minimum(edges, len(marks) - 1)], firsts]))
        stops = np.append(starts[1:], n)
        text = np.searchsorted(firsts, starts, "right") - 1
        order = np.argsort(starts - stops, kind="stable")  # longest first, so that live runs stay a prefix
        starts, stops, text = starts[order], stops[order], text[order]
        counts = np.zeros(len(starts), np.int64)
        ends = np.zeros(n, np.int32) if want_ids else None
        state = np.zeros(len(starts), np.int64)
        lengths, live = stops - starts, len(starts)
        for low in range(0, int(lengths[0]) if n else 0, STRIDE):
            # The next STRIDE bytes of all live runs, one row a step.
            live = int(np.searchsorted(-lengths, -low, "left"))
            at = np.minimum(starts[:live] + np.arange(low, low + STRIDE)[:, None], n - 1)
            bytes_, kept = data[at].astype(np.int64), np.where(begins[at], 0, -1)
            tokens = np.empty(at.shape, np.int32) if want_ids else None
            for k in range(min(STRIDE, int(lengths[0]) - low)):
                now_live = int(np.searchsorted(-lengths[:live], -(low + k), "left"))
                state[:now_live] &= kept[k, :now_live]
                noted = self._advance(state[:now_live], bytes_[k, :now_live], want_ids)
                if want_ids:
                    tokens[k, :now_live] = noted
                else:
                    counts[:now_live] += noted
            if want_ids:
                inside = np.arange(low, low + STRIDE)[:, None] < lengths[:live]
                ends[at[inside]] = tokens[inside]
        return text, counts, self._ends(ends, starts, stops, begins) if want_ids else None

    def _ends(self, last: np.ndarray, starts: np.ndarray, stops: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Walk back from each run's end over its tokens; keep the ordinals at the bytes where tokens end."""
        out = np.full(len(last), -1, np.int32)
        at, low = stops - 1, starts
        while len(at):
            token = last[at]
            out[at] = token
            at = at - self.length[token]
            live = at >= low
            at, low = at[live], low[live]
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray, want_ids: bool = False) -> tuple[np.ndarray, list[np.ndarray] | None]:
        """Token counts of UTF-8 texts (bytes, offsets), with special strings as single tokens, and their ids if asked."""
        n_texts = len(offsets) - 1
        whole = data.tobytes()
        # Cut out special strings: pieces between them are texts of their own.
        cuts: list[tuple[int, int, int]] = []
        for s, number in self.special.items():
            b, k = s.encode(), whole.find(s.encode())
            while k >= 0:
                t = int(np.searchsorted(offsets, k, "right")) - 1
                if k + len(b) <= offsets[t + 1]:
                    cuts.append((k, k + len(b), number))
                    k = whole.find(b, k + len(b))
                else:
                    k = whole.find(b, k + 1)
        cuts.sort()
        counts = np.zeros(n_texts, np.int64)
        firsts = offsets[:-1][np.diff(offsets) > 0]
        body = data
        if cuts:
            keep = np.ones(len(data), bool)
            for a, b, _ in cuts:
                keep[a:b] = False
            np.add.at(counts, np.searchsorted(offsets, [a for a, _, _ in cuts], "right") - 1, 1)
            firsts = np.unique(np.concatenate([firsts, [b for _, b, _ in cuts]]))
            body = data[keep]
            del keep
            opens, closes, _ = (np.array(x, np.int64) for x in zip(*cuts, strict=True))
            gone = np.concatenate([[0], np.cumsum(closes - opens)])  # bytes cut out before each special string and after the last
            here = firsts - gone[np.searchsorted(closes, firsts, "right")]
            own = np.searchsorted(offsets, firsts, "right") - 1
            real = np.append(np.diff(here), len(body) - here[-1]) > 0 if len(here) else np.zeros(0, bool)
            real &= firsts < len(data)
            firsts, own = here[real], own[real]
        else:
            own = np.searchsorted(offsets, firsts, "right") - 1
        ends = np.zeros(0, np.int32)
        if len(body):
            text, found, ends = self.run(body, _begins(body, firsts), firsts, want_ids)
            np.add.at(counts, own[text], found)
        if not want_ids:
            return counts, None
        # The rest goes over the bytes in place: several arrays of whole blocks would be most of a worker's memory.
        at = np.flatnonzero(ends >= 0) if len(body) else np.zeros(0, np.int64)
        values = self.id[ends[at]].astype(np.uint32)
        del ends
        if cuts:
            at = np.concatenate([at + gone[np.searchsorted(opens - gone[:-1], at, "right")], closes - 1])
            order = np.argsort(at, kind="stable")
            at, values = at[order], np.concatenate([values, np.array([number for _, _, number in cuts], np.uint32)])[order]
        edges = np.searchsorted(at, offsets)
        return np.diff(edges), [values[edges[k] : edges[k + 1]] for k in range(n_texts)]


@lru_cache(2)
def transducer(path: str) -> Transducer:
    """One per worker process and vocabulary."""
    return Transducer(path)
