"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two machines, both annotated with counts.

*Cutter*: a transducer over classes of characters that marks where pre-tokens
begin.  Its pattern is the fixed one of the ByteLevel pre-tokenizer::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

All texts of a block, with a separator between them, are one stream, cut into
chunks of equal length whatever text they are in.  A chunk is a map from entry
state to exit state; the maps compose by a parallel prefix scan, which gives
every chunk its entry state; then all chunks run at once and emit their marks.

*Counter*: a deterministic transducer over bytes whose transitions carry the
change in the number of tokens.  A prefix's last token in the merge result
decides it: token t can follow if the pair (last token before t, t) merges to
itself, and exactly one token does.  A state is what decides the future: for
each suffix of the prefix that begins some longer token, its place in the trie,
the last token before it and the count since then.  States and transitions are
compiled when first met; where there are more than ``STATES``, compilation starts
anew with those in use.  A pre-token longer than ``PIECE`` runs as pieces side by
side, each from ``WARM`` bytes before it: what a state holds reaches a token's
length back, so that soon it no longer depends on where the run began.  The
pieces' maps compose in order: where a piece began in the state that the one
before ends in, its count stands; else it runs again from that state.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merge_blocks, text_bytes

CHUNK = 512
STATES = 100_000
PIECE, WARM = 1024, 96
LIMIT = 512
#: Rows by which the tables grow.
ROOM = 16_384

# Classes of characters.  s, t, m, d end a contraction; r, v want e; l wants l.
LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, STMD, R, V, E, ELL, BREAK = range(12)
# States of the cutter.
START, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CLOSED, ONE_SPACE, ONE_WHITE, SPACES, WHITES = range(13)
HERE, BACK = 1, 2  #: marks: a pre-token begins at this character; at the one before
_LETTERS = {LETTER, STMD, R, V, E, ELL}


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and marks on a character of class c."""
    if c == BREAK:
        return START, HERE | (BACK if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
    fresh = LETTERS if c in _LETTERS else {NUMBER: NUMBERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, OTHER: OTHERS, QUOTE: QUOTED}[c]
    white = c in (SPACE, WHITE)
    if state == LETTERS and c in _LETTERS or state == NUMBERS and c == NUMBER or state == OTHERS and c in (OTHER, QUOTE):
        return state, 0
    if state == QUOTED:
        if c == STMD:
            return CLOSED, 0
        if c in (R, V, ELL):
            return {R: QUOTED_R, V: QUOTED_V, ELL: QUOTED_L}[c], 0
        if c in (OTHER, QUOTE):
            return OTHERS, 0
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if c == (ELL if state == QUOTED_L else E):
            return CLOSED, 0
        return (LETTERS, BACK) if c in _LETTERS else (fresh, BACK | HERE)
    if state in (ONE_SPACE, ONE_WHITE, SPACES, WHITES):
        if white:
            return (SPACES if c == SPACE else WHITES), 0
        back = BACK if state in (SPACES, WHITES) else 0
        if state in (ONE_SPACE, SPACES):  # the space goes with what follows; an apostrophe after it opens no contraction
            return (OTHERS if c == QUOTE else fresh), back
        return fresh, back | HERE
    return fresh, HERE


_NEXT = np.array([[_step(s, c)[0] for c in range(12)] for s in range(13)], np.int8)
_MARK = np.array([[_step(s, c)[1] for c in range(12)] for s in range(13)], np.int8)


class Classes:
    """Classes of code points; outside ASCII each is looked up when first met."""

    def __init__(self):
        self.known = np.full(0x110000, -1, np.int8)
        for c in range(128):
            self.known[c] = self._of(chr(c))

    @staticmethod
    def _of(ch: str) -> int:
        import regex

        if ch in "stmdrvel'":
            return {"r": R, "v": V, "e": E, "l": ELL, "'": QUOTE}.get(ch, STMD)
        if ch == " ":
            return SPACE
        for c, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\p{White_Space}")):
            if regex.fullmatch(pattern, ch):
                return c
        return OTHER

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.known[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]):
                self.known[p] = self._of(chr(p))
            out = self.known[points]
        return out


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix composition: row i becomes the map of chunks 0 to i."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], 1)
        gap *= 2
    return maps


def cut_marks(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens begin in a stream of classes; each BREAK is one too."""
    n = len(classes)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, BREAK, np.int8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    # maps: run every entry state, until all that matter have met
    state = np.tile(np.arange(13, dtype=np.int8), (rows, 1))
    step = 0
    while step < chunk and (state != state[:, :1]).any():
        state = _NEXT[state, grid[step][:, None]]
        step += 1
    one = state[:, 0].copy()
    met = step < chunk
    for k in range(step, chunk):
        one = _NEXT[one, grid[k]]
    maps = scan(np.repeat(one[:, None], 13, 1) if met else state)
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.int8)
    begins = np.zeros(rows * chunk + 1, bool)
    marks = np.empty((chunk, rows), np.int8)
    for k in range(chunk):
        marks[k] = _MARK[state, grid[k]]
        state = _NEXT[state, grid[k]]
    marks = marks.T.reshape(-1)
    begins[:-1] = marks & HERE
    begins[: len(marks) - 1] |= (marks[1:] & BACK) > 0
    return begins[:n]


class Counter:
    """Counts the tokens of pre-tokens, given as bytes."""

    def __init__(self, vocab: dict[str, int], merges: list):
        from tokenizers.pre_tokenizers import ByteLevel  # noqa: F401  the alphabet's order is the library's

        to_byte = {c: b for b, c in byte_alphabet().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        ids = {raw(t): i for t, i in vocab.items()}
        self.bytes = {i: t for t, i in ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, i in ids.items():
            node = 0
            for b in t:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = i
        self.stands: dict[tuple[int, int], bool] = {}
        self.spines: dict[int, tuple | None] = {}
        self._anew(np.zeros(0, np.int64))

    def _anew(self, kept: np.ndarray) -> np.ndarray:
        """Empty tables but for the states that are kept; their new numbers."""
        old = [self.states[i] for i in kept.tolist()]
        start = ((0, -1, 0),)
        self.states = list(dict.fromkeys([start, *old]))
        self.index = {key: i for i, key in enumerate(self.states)}
        rows = -(-(len(self.states) + 1) // ROOM) * ROOM
        self.column = np.full(256, -1, np.int16)  # of a byte, in the order in which they are met
        self.next = np.full((rows, 128), -1, np.int32)
        self.delta = np.zeros((rows, 128), np.int8)
        return np.array([self.index[key] for key in old], np.int32)

    def _spine(self, token: int) -> tuple | None:
        """What stands at a token's left and right end while it is merged, each list from the token itself to a byte.

        Entries are (token, rank of the merge that makes it).  None if merging the token's bytes doesn't give the token.
        """
        if token not in self.spines:
            out, at = [self.single[b] for b in self.bytes[token]], -1
            left, right = [(out[0], -1)], [(out[-1], -1)]
            while len(out) > 1:
                best = min(((self.rank[p][0], k) for k, p in enumerate(zip(out, out[1:])) if p in self.rank), default=None)
                if best is None:
                    break
                at, k = best
                if k == 0:
                    left.append((self.rank[out[0], out[1]][1], at))
                if k == len(out) - 2:
                    right.append((self.rank[out[-2], out[-1]][1], at))
                out[k : k + 2] = [self.rank[out[k], out[k + 1]][1]]
            self.spines[token] = (left[::-1], right[::-1]) if out == [token] else None
        return self.spines[token]

    def _valid(self, left: int, right: int) -> bool:
        """Whether two tokens side by side (or one alone) merge to themselves: nothing merges across the border at any time."""
        key = left, right
        if key not in self.stands:
            if len(self.stands) > 1_000_000:
                self.stands.clear()
            self.stands[key] = self._stands(left, right)
        return self.stands[key]

    def _stands(self, left: int, right: int) -> bool:
        after = self._spine(right)
        if left < 0 or after is None:
            return after is not None
        before = self._spine(left)
        if before is None:
            return False
        # back in time: what was merged last comes apart first; of equal merges the left one is earlier
        i = j = 0
        until_left = until_right = len(self.rank)  # ranks at which the two ends are merged into more
        while True:
            (x, made_x), (y, made_y) = before[1][i], after[0][j]
            pair = self.rank.get((x, y))
            if pair is not None and pair[0] < until_left and pair[0] <= until_right:
                return False
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                i, until_left = i + 1, made_x
            else:
                j, until_right = j + 1, made_y

    def _compile(self, state: int, byte: int) -> None:
        """One transition; a state's entries are (trie node, last token before, tokens from there to the prefix's end)."""
        moved, last, change = [], None, 0
        for node, left, since in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            moved.append((to, left, since))
            t = self.token[to]
            if last is None and t >= 0 and self._valid(left, t):
                last, change = t, 1 - since
        key = tuple((to, left, since + change) for to, left, since in moved if self.child[to]) + ((0, last, 0),)
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.states)
            self.states.append(key)
            self._room(at)
        self.next[state, self.column[byte]] = at
        self.delta[state, self.column[byte]] = change

    def _room(self, state: int) -> None:
        if state >= len(self.next):
            self.next = np.concatenate([self.next, np.full((ROOM, self.next.shape[1]), -1, np.int32)])
            self.delta = np.concatenate([self.delta, np.zeros((ROOM, self.next.shape[1]), np.int8)])

    def _columns(self, data: np.ndarray) -> None:
        """Gives each byte that is met for the first time a column of the tables."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0))
        used = int(self.column.max()) + 1
        self.column[new] = np.arange(used, used + len(new))
        if used + len(new) > self.next.shape[1]:
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)], 1)
            self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)], 1)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a byte each, and changes in the number of tokens."""
        at = self.column[byte]
        to = self.next[state, at]
        if (to < 0).any():
            wanting = np.unique(state[to < 0].astype(np.int64) * 256 + byte[to < 0])
            for x in wanting.tolist():
                self._compile(x >> 8, x & 255)
            to = self.next[state, at]
        return to, self.delta[state, at]

    def count(self, words: pa.Array) -> np.ndarray:
        """Number of tokens of each of a binary array's values; all, and the pieces of long ones, run side by side."""
        bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
        length = np.diff(bounds)
        many = np.maximum(1, -(-length // PIECE))
        owner = np.repeat(np.arange(len(length)), many)
        no = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        warm = np.where(no > 0, WARM, 0)
        begin = bounds[:-1][owner] + no * PIECE - warm
        size = np.minimum(PIECE, length[owner] - no * PIECE) + warm
        total, first, last = self._run(data, begin, size, warm, np.zeros(len(owner), np.int32))
        for k in np.flatnonzero(no > 0).tolist():  # the maps compose in order; pieces of a word follow one another
            if first[k] != last[k - 1]:
                at = self.index.get(last[k - 1])
                if at is None:
                    at = self.index[last[k - 1]] = len(self.states)
                    self.states.append(last[k - 1])
                    self._room(at)
                one = np.array([k])
                again, _, end = self._run(data, begin[one] + WARM, size[one] - WARM, np.zeros(1, np.int64), np.array([at], np.int32))
                total[k], last[k] = again[0], end[0]
        return np.bincount(owner, weights=total, minlength=len(length)).astype(np.int64)

    def _run(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, warm: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list, list]:
        """Per run of ``size`` bytes: tokens counted from the ``warm``-th byte on, and the states there and at its end, which only long words have."""
        order = np.argsort(-size, kind="stable")
        begin, size, warm, state = begin[order], size[order], warm[order], state[order]
        cut = (size >= PIECE) | (warm > 0)
        first, last = [None] * len(order), [None] * len(order)
        self._columns(data)
        live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # runs longer than k
        total = np.zeros(len(order), np.int64)
        for k, n in enumerate(live):
            if len(self.states) > max(STATES, 4 * n):
                used = np.unique(state[:n])
                state[:n] = self._anew(used)[np.searchsorted(used, state[:n])]
                self._columns(data)
            if k == WARM:
                for i in np.flatnonzero(warm[:n] > 0).tolist():
                    first[i] = self.states[state[i]]
            to, change = self._step(state[:n], data[begin[:n] + k])
            total[:n] += change if k >= WARM else np.where(warm[:n] <= k, change, 0)
            state[:n] = to
            left = live[k + 1] if k + 1 < len(live) else 0
            for i in (np.flatnonzero(cut[left:n]) + left).tolist():  # those that end here
                last[i] = self.states[state[i]]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return total[back], [first[i] for i in back], [last[i] for i in back]


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable Latin-1 bytes are themselves, the others follow from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class TokenCounter:
    """Token counts of whole texts as the tokenizer's library gives them, without added special tokens.

    Strings of special tokens inside texts are one token each, as by the
    library's default.  Raises on tokenizer files of another kind.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        odd = model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        added = spec.get("added_tokens", [])
        if model.get("type") != "BPE" or not plain or odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: only byte-level BPE with the usual pattern is compiled")
        vocab = {t: i for t, i in model["vocab"].items()}
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.counter, self.classes = Counter(vocab, model["merges"]), Classes()

    def count(self, texts: list[bytes]) -> np.ndarray:
        """A text's special tokens are cut out first; then texts and their parts are one stream with breaks between."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = [t]
            for s in self.special:
                if any(s.encode() in x for x in own):
                    own = [y for x in own for y in x.split(s.encode())]
            extra[i] = len(own) - 1
            parts += own
            owner += [i] * len(own)
        stream = "\0".join(x.decode("utf-8", "replace") for x in parts) + "\0"
        points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(x.decode("utf-8", "replace")) for x in parts], np.int64)
        breaks = np.cumsum(lengths + 1) - 1
        classes = self.classes.of(points)
        classes[breaks] = BREAK
        begins = cut_marks(classes)
        at = np.flatnonzero(begins)
        data = stream.encode()
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.cumsum(width) - width
        bounds = np.append(offset[at], len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        n = self.counter.count(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        is_break = np.isin(at, breaks, assume_unique=True)
        n[is_break] = 0
        part_of = np.searchsorted(breaks, at)
        return extra + np.bincount(np.array(owner)[part_of], weights=n, minlength=len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row per document; a null or empty text has no tokens.  No shuffle."""

    def run(batches):
        counter = None
        for batch in merge_blocks(batches, limit=4 << 20):
            counter = counter or TokenCounter(tokenizer)
            texts = text_bytes(batch.column(1))
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
