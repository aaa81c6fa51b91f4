"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

A rank file fixes the token sequence of a piece: neighbours of lowest rank merge first.
Whether a sequence is that result depends on neighbouring tokens only: it is when every
pair of neighbours merges back to the same pair. So the merges compile into a
nondeterministic transducer: a configuration is (last token, node in the trie of
tokens); a byte moves every configuration down the trie, and where the node is a
token that may follow the last one, also back to the root. Determinising makes a state of all
configurations that are alive, where of the last token only that counts which of the tokens
below the node may follow it. Every prefix has exactly one token sequence, so a transition yields one
token: the one that ends there. A token is emitted as soon as the sequences of all live
configurations pass its end; they live no longer than the longest token, so the
lookahead is bounded. States and transitions are built on first use and kept in a bounded table,
so a piece costs time linear in its bytes, whatever its length. Should a vocabulary
break the rule of unique prefixes, the transducer notices and the piece is merged directly.

Decoding runs a UTF-8 state machine over the tokens: a token may end inside a
character, whose first bytes then wait for the next token. Its steps for whole tokens
are composed on first use as well.

Spark maps both over Arrow batches of whole texts; nothing is shuffled."""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_STATES, MAX_PAIRS, MAX_KNOWN = 1 << 16, 1 << 17, 1 << 19  # the tables start anew beyond these; they only save work
FLUSH = 1 << 14
SUBTREE = 64
KNOWN_CHARS = 64
# Cuts where the pieces of the public pattern end anyway: before white space (Unicode's
# White_Space, to which the four separators \x1c-\x1f do not belong) after anything else.
SPACE_CUTS = r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+"
MARKS = "!#$%&*,.;:?)]}"  # ASCII characters that are neither letter, number nor white space
_CODERS: dict[tuple, "Coder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a file with lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[int]:
    """Ids of a piece by direct merging: the leftmost pair of lowest rank first, as long as
    the rank is less than ``below``. The definition the transducer is compiled from."""
    n = len(piece)
    end, left, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []  # of the part that starts at i

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            rank = ranks.get(piece[i:end[end[i]]])
            if rank is not None and rank < below:
                heapq.heappush(heap, (rank, i, end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if end[i] == 0 or end[i] == n or end[end[i]] != stop:  # merged away or grown since
            continue
        gone = end[i]
        end[i], end[gone] = stop, 0
        if stop < n:
            left[stop] = i
        offer(left[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Ambiguous(Exception):
    """The vocabulary gives a prefix no token sequence, or several."""


class Transducer:
    """``encode`` gives the ids of one piece. All single bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.ranks, self.max_states = ranks, max_states
        self.token = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.ends: dict[int, int] = {}
        self.sorted = [i for _, i in sorted(ranks.items())]  # tokens below a node lie side by side
        self.size = {i: len(t) for t, i in ranks.items()}
        below, past, self.depth = [0], [len(ranks)], [0]
        for at, i in enumerate(self.sorted):
            node = 0
            for b in self.token[i]:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(below)
                    below.append(at)
                    past.append(at)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
                past[node] = at + 1
            self.ends[node] = i
            below[node] = at + 1  # strictly below
        self.below, self.past = below, past
        self.pairs: dict[int, bool] = {}
        self.open: dict[int, tuple] = {}
        self.halves: dict[int, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        self.states = [((0, None),)]
        self.number = {self.states[0]: 0}
        self.table: dict[int, tuple[int, int]] = {}  # state << 8 | byte

    def _split(self, token: int) -> list[int]:
        """The two tokens whose merge makes this one (the token alone: a byte)."""
        got = self.halves[token] = merge(self.token[token], self.ranks, below=token)
        return got

    def _may_follow(self, last: int | None, token: int) -> bool:
        """Whether the two tokens, as neighbours, are what their bytes merge to. Undoes the merges
        along the seam, latest first: the pair holds if nothing merges across the seam
        before the merge undone last, or at its rank further left."""
        key = token if last is None else (last + 1) << 32 | token
        ok = self.pairs.get(key)
        if ok is not None:
            return ok
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        if last is None:
            ok = merge(self.token[token], self.ranks) == [token]
        else:
            a, b, limit, halves = last, token, float("inf"), self.halves
            while True:
                across = self.ranks.get(self.token[a] + self.token[b])
                if across is not None and across < limit:
                    ok = False
                    break
                left, right = halves.get(a) or self._split(a), halves.get(b) or self._split(b)
                if len(left) > 2 or len(right) > 2:  # no token that merges make: try it out
                    ok = merge(self.token[last] + self.token[token], self.ranks) == [last, token]
                    break
                if len(left) == len(right) == 1:
                    ok = True
                    break
                if len(right) == 1 or len(left) == 2 and a > b:
                    limit, a = a, left[1]
                else:
                    limit, b = b + 1, right[0]  # at equal rank the seam lies further left
        self.pairs[key] = ok
        return ok

    def _allowed(self, last: int | None, node: int) -> tuple:
        """Places (in the order of tokens) of the tokens strictly below ``node`` that may follow ``last``."""
        key = node if last is None else (last + 1) << 32 | node
        got = self.open.get(key)
        if got is None:
            if len(self.open) >= MAX_PAIRS:
                self.open.clear()
            got = self.open[key] = tuple([k for k in range(self.below[node], self.past[node]) if self._may_follow(last, self.sorted[k])])
        return got

    def _step(self, key: int) -> tuple[int, int]:
        """Build the transition of ``state << 8 | byte``: the next state (shifted), and the token that ends the
        sequence of what was read so far."""
        byte, alive, ended = key & 255, [], []
        for node, past in self.states[key >> 8]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            token, lo, hi = self.ends.get(nxt), self.below[nxt], self.past[nxt]
            if type(past) is tuple:
                ends = token is not None and lo - 1 in past
                past = tuple([k for k in past if lo <= k < hi])
            else:
                ends = token is not None and self._may_follow(past, token)
                if hi - lo <= SUBTREE:
                    past = self._allowed(past, nxt)
            if ends:
                ended.append(token)
            if past != ():
                alive.append((nxt, past))
        if len(ended) != 1:
            raise Ambiguous
        alive.append((0, ended[0]))
        state = tuple(alive)
        at = self.number.get(state)
        if at is None:
            if len(self.states) >= self.max_states:
                self._reset()
                key = None
            at = self.number[state] = len(self.states)
            self.states.append(state)
        step = (at << 8, ended[0])
        if key is not None:
            self.table[key] = step
        return step

    def settled(self, last: list[int], state: int) -> int:
        """Up to where the tokens cannot change any more, whatever bytes follow: the last place that the sequences
        of all live configurations pass. ``last`` holds the token that ends at each byte read."""
        starts = {len(last) - self.depth[node] for node, _ in self.states[state >> 8]}
        while len(starts) > 1:
            latest = max(starts)
            starts.remove(latest)
            starts.add(latest - len(self.token[last[latest - 1]]))
        return starts.pop()

    def _emit(self, last: list[int], upto: int) -> list[int]:
        out = []
        while upto:
            token = last[upto - 1]
            out.append(token)
            upto -= self.size[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece. What is settled leaves every ``FLUSH`` bytes, so little is held of a long piece."""
        out: list[int] = []
        last: list[int] = []
        state = 0
        try:
            for at in range(0, len(piece), FLUSH):
                if at:
                    done = self.settled(last, state)
                    out += self._emit(last, done)
                    del last[:done]
                table = self.table
                for byte in piece[at:at + FLUSH]:
                    try:
                        state, token = table[state | byte]
                    except KeyError:
                        state, token = self._step(state | byte)
                        table = self.table
                    last.append(token)
        except Ambiguous:
            return merge(piece, self.ranks)
        return out + self._emit(last, len(last))


# Bytes that may follow, and where they lead: state -> [(first, last, next state)]. State 0 is
# between characters; 1 to 3 wait for as many continuation bytes; 4 to 7 do, with the narrower
# second byte after E0, ED, F0, F4. Fixed by the encoding's definition.
UTF8 = {0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
            (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
        1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)],
        4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)]}
_NEXT = {s: {b: to for lo, hi, to in moves for b in range(lo, hi + 1)} for s, moves in UTF8.items()}


class StreamDecoder:
    """Ids to text, piece by piece: ``feed`` returns the characters that are complete,
    ``finish`` what is left. Bytes that are no UTF-8 become U+FFFD with ``errors='replace'`` (one for
    each longest start of a character) and stay as they are with ``errors='keep'``;
    ``invalid`` counts them either way. Unknown ids raise ``ValueError``."""

    def __init__(self, tokens: dict[int, bytes], errors: str = "replace"):
        if errors not in ("replace", "keep"):
            raise ValueError("errors is 'replace' or 'keep'")
        self.tokens, self.keep = tokens, errors == "keep"
        self.steps: dict[tuple[int, bytes], tuple[bytes, tuple[int, bytes], int]] = {}
        self.whole: dict[int, bytes] = {}  # tokens that are whole characters, met between characters
        self.restart()

    def restart(self) -> None:
        self.state, self.waiting, self.invalid = 0, b"", 0

    def _bad(self, some: bytes) -> bytes:
        return some if self.keep else "�".encode()

    def _compose(self, token: int) -> tuple:
        out, state, waiting, invalid = bytearray(), self.state, self.waiting, 0
        if token not in self.tokens:
            raise ValueError(f"no token has the id {token}")
        for b in self.tokens[token]:
            to = _NEXT[state].get(b)
            if to is None and state:  # the character under way is cut short; b starts anew
                out += self._bad(waiting)
                invalid, state, waiting = invalid + 1, 0, b""
                to = _NEXT[0].get(b)
            if to is None:
                out += self._bad(bytes([b]))
                invalid += 1
                continue
            state, waiting = to, waiting + bytes([b])
            if state == 0:
                out += waiting
                waiting = b""
        step = (bytes(out), (state, waiting), invalid)
        if len(self.steps) >= MAX_KNOWN:
            self.steps.clear()
        self.steps[token, self.waiting] = step
        if not self.waiting and not waiting and not invalid:
            self.whole[token] = step[0]
        return step

    def feed(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of the characters these ids complete."""
        whole = self.whole
        if not self.waiting:
            try:  # most texts: whole characters only, seen before
                return b"".join(map(whole.__getitem__, ids))
            except KeyError:
                pass
        out = []
        for i in ids:
            if not self.waiting:
                some = whole.get(i)
                if some is not None:
                    out.append(some)
                    continue
            step = self.steps.get((i, self.waiting)) or self._compose(i)
            out.append(step[0])
            self.state, self.waiting = step[1]
            self.invalid += step[2]
        return b"".join(out)

    def finish(self) -> bytes:
        """What waits for bytes that never came; the decoder is ready for the next text."""
        rest = self._bad(self.waiting) if self.waiting else b""
        self.invalid += bool(self.waiting)
        self.state, self.waiting = 0, b""
        return rest


class Coder:
    """Whole texts to ids. A text is cut into pieces by ``pattern``; a piece that is a token is that token, any other
    goes through the transducer. Ids of short pieces are remembered, a bounded number. ``cuts`` is for the
    public pattern: parts at whose ends pieces end, where a part of letters, with a space
    before them or not, and then ASCII marks is two pieces. It only saves time."""

    def __init__(self, ranks_file: str, pattern: str, cuts: str | None = None):
        import re

        import regex

        self.ranks = read_ranks(ranks_file)
        self.transducer = Transducer(self.ranks)
        self.pieces = regex.compile(pattern).findall
        self.by_words = cuts is not None
        self.cuts = re.compile(cuts).findall if cuts else lambda text: [text]
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            token = self.ranks.get(raw)
            found = array("i", self.transducer.encode(raw) if token is None else [token]).tobytes()
            if len(piece) <= KNOWN_CHARS:
                if len(self.known) >= MAX_KNOWN:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _part(self, part: str) -> bytes:
        if self.by_words:
            word = part.rstrip(MARKS)
            if (word[1:] if word[:1] == " " else word).isalpha():  # letters, then marks: two pieces
                return self._piece(word) + (self._piece(part[len(word):]) if len(word) < len(part) else b"")
        return b"".join([self._piece(p) for p in self.pieces(part)])

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        known, part = self.known.get, self._part
        return b"".join([known(p) or part(p) for p in self.cuts(text)])


def coder(ranks_file: str, pattern: str, cuts: str | None) -> Coder:
    """One coder per worker process and vocabulary."""
    key = (ranks_file, pattern, cuts)
    if key not in _CODERS:
        _CODERS[key] = Coder(*key)
    return _CODERS[key]


def _append(batch, name: str, column):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    if name in schema.names:
        raise ValueError(f"there is a column {name} already: name another")
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def _encoder(ranks_file: str, pattern: str, cuts: str | None, at: int, name: str):
    def step(b):
        import pyarrow as pa

        code = coder(ranks_file, pattern, cuts).encode
        raw = [code(t.decode("utf-8", "replace")) if t else b"" for t in b.column(at).cast(pa.large_binary()).to_pylist()]
        ends = np.cumsum([0] + [len(r) // 4 for r in raw], dtype=np.int32)
        values = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
        return _append(b, name, pa.ListArray.from_arrays(pa.array(ends), values))
    return step


def _decoder(ranks_file: str, at: int, name: str, errors: str):
    machine = []

    def step(b):
        import pyarrow as pa

        if not machine:
            machine.append(StreamDecoder({i: t for t, i in read_ranks(ranks_file).items()}, errors))
        out = []
        for ids in b.column(at):
            machine[0].restart()
            out.append(machine[0].feed(ids.values.to_pylist() if ids.is_valid else ()) + machine[0].finish())
        return _append(b, name, pa.array(out, pa.binary()))
    return step


def _mapped(rows: DataFrame, schema: T.StructType, *steps) -> DataFrame:
    """Each batch through all steps in one worker."""
    def run(batches):
        for b in batches:
            for step in steps:
                b = step(b)
            yield b

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
           cuts: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col``: the token ids of the whole text (array of int), each match of
    ``pattern`` by itself, no special tokens. ``cuts``: ``SPACE_CUTS`` for the public pattern, else none (see ``Coder``).

    Null and empty texts have no ids. Invalid UTF-8 counts as U+FFFD. Repeated rows stay
    repeated, an empty table gives an empty result, all columns are kept, and
    a column that is already called ``ids_col`` is an error. The rank file must be
    readable under its path by every worker."""
    return _mapped(docs, _with(docs.schema, ids_col, T.ArrayType(T.IntegerType())),
                   _encoder(ranks_file, pattern, cuts, docs.columns.index(text_col), ids_col))


def decode(rows: DataFrame, ranks_file: str, ids_col: str = "ids", out_col: str = "decoded",
           errors: str = "replace") -> DataFrame:
    """``rows`` with ``out_col``: the bytes (binary) that the ids stand for; ``errors`` as in
    ``StreamDecoder``: with ``'replace'`` the bytes are always UTF-8.

    Null and empty id lists give empty bytes; a null or unknown id fails the job. Repeated rows stay
    repeated, an empty table gives an empty result, all columns are kept, and a
    column that is already called ``out_col`` is an error."""
    return _mapped(rows, _with(rows.schema, out_col, T.BinaryType()), _decoder(ranks_file, rows.columns.index(ids_col), out_col, errors))


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded",
               cuts: str | None = None, errors: str = "replace") -> DataFrame:
    """``decode`` of ``encode``, in one pass through the Python workers; cases as there."""
    schema = _with(_with(docs.schema, ids_col, T.ArrayType(T.IntegerType())), out_col, T.BinaryType())
    return _mapped(docs, schema, _encoder(ranks_file, pattern, cuts, docs.columns.index(text_col), ids_col),
                   _decoder(ranks_file, len(docs.columns), out_col, errors))


def digests(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
            cuts: str | None = SPACE_CUTS) -> DataFrame:
    """Encode and decode every text: id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas),
    ``decoded_sha256`` (decoded bytes). Nulls and other cases as in ``encode``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    both = round_trip(rows, ranks_file, pattern, "text", "ids", "decoded", cuts, errors="keep")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
