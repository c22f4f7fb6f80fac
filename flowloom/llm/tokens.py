"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary tokenizes any prefix of a text in exactly one way, and the
last token of a prefix is fixed by the last tokens of the prefixes up to one piece
length before it: token t ends a prefix if the prefix before it ends in a token u
such that u and t stay apart when they are tokenized together. So the machine's
state is the longest text suffix that may still grow into a piece, with the last
token at each position inside it; a transition reads one character and carries the
change of the token count. States are made when first reached, as in a lazily
determinised automaton, and the table is dropped when it outgrows its bound.

A piece never holds a word mark behind another character, and never a line feed, so
the machine is back in its start state at each such place. The state map of a chunk
therefore is short: its head, up to the first such place, is what an entering state still
has to read; behind it, the count and the state in which the machine leaves are the same
for all. Maps compose associatively: the state in which one leaves enters the next. A
document's chunks are composed in pairs, as the first half of a parallel prefix scan does
it; a count only needs the last prefix. A text without any such place is all head, and is
read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
MAX_STATES = 120_000
MAX_MEMO = 250_000
MEMO_CHARS = 48
CHUNK_CHARS = 1 << 16
STRETCH = 4_096  # characters between two looks at the table's size


def read_vocabulary(path: str) -> dict[str, float]:
    """The mergeable pieces of a sentencepiece BPE model, with their scores.

    Only models with identity normalisation, a dummy prefix and byte fallback are
    taken; others change texts before merging.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    if not any(model.is_byte(i) for i in ids):
        raise ValueError(f"{path} has no byte fallback")
    if model.encode(" a ", out_type=str)[0][:2] != MARK * 2 and model.encode("  ") == model.encode(" "):
        raise ValueError(f"{path} drops white space")
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}


class StateMap(NamedTuple):
    """A chunk as a function from states to states and counts: an entering state reads the
    heads; if there is an exit, it then counts ``inner`` and leaves in the exit state."""

    heads: tuple[str, ...]
    inner: int
    exit: _State | None


class _State:
    __slots__ = ("last", "moves", "rel", "suffix")

    def __init__(self, suffix: str, last: tuple, rel: tuple) -> None:
        self.suffix, self.last, self.rel, self.moves = suffix, last, rel, {}


class TokenTransducer:
    """Counts the tokens of texts under one vocabulary."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p))}
        self.best: dict[str, float] = {}  # by prefix, the best score of a longer piece
        for p, score in pieces.items():
            for k in range(1, len(p)):
                if score > self.best.get(p[:k], -1e30):
                    self.best[p[:k]] = score
        self.edges: dict[str, tuple] = {}
        self.signs: dict[tuple[str, str], tuple] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word mark behind another character")
        lines = "" if any("\n" in p for p in pieces) else "\n"
        self.segments = re.compile(f"{MARK}+[^{MARK}{lines}]*|[^{MARK}{lines}]+" + ("|\n" if lines else "")).findall
        self.memo: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        self.start, self.states = _State("", (None,), (0,)), {}

    def _merge(self, text: str) -> list[str]:
        """Plain merging of a short text: the best piece first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            score, at = max(((self.pieces.get(a + b, -1e30), -k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if score == -1e30:
                break
            parts[-at : -at + 2] = [parts[-at] + parts[-at + 1]]
        return parts

    def _edge(self, u: str) -> tuple:
        """The symbols that were rightmost while u was merged, each with the score at which it was merged away.

        None first if some merge scores no less than the ones below it: then u is told apart from all others.
        """
        if (found := self.edges.get(u)) is None:
            parts, edge, even = list(u), [], True
            while len(parts) > 1:
                score, at = max(((self.pieces.get(a + b, -1e30), -k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
                if score == -1e30:
                    break
                a, b = parts[-at : -at + 2]
                even = even and all(len(x) == 1 or self.pieces[x] > score for x in (a, b))
                if -at == len(parts) - 2:
                    edge.append((b, score))
                parts[-at : -at + 2] = [a + b]
            found = self.edges[u] = (even, *edge, (parts[-1], -1e30))
        return found

    def _sign(self, u: str | None, w: str) -> tuple | str | None:
        """What of last token u can matter to tokens that start with w: states that differ in nothing else are one."""
        if u is None:
            return None
        if (found := self.signs.get((u, w))) is None:
            even, *edge = self._edge(u)
            if len(self.signs) > MAX_MEMO:
                self.signs.clear()
            if even:
                found = tuple((v, gone) for v, gone in edge if self.best.get(v + w, -1e31) > gone or any(self.pieces.get(v + w[:k], -1e31) > gone for k in range(1, len(w) + 1)))
            else:
                found = u
            self.signs[u, w] = found
        return found

    def _follows(self, u: str | None, t: str) -> bool:
        if t not in self.whole:
            self.whole[t] = len(self._merge(t)) == 1
        if u is None or not self.whole[t]:
            return self.whole[t]
        if (found := self.apart.get((u, t))) is None:
            if len(self.apart) > MAX_MEMO:
                self.apart.clear()
            found = self.apart[u, t] = self._merge(u + t) == [u, t]
        return found

    def _move(self, state: _State, char: str) -> tuple[_State, int]:
        """The transition of a state on a character: the next state and the change of the count."""
        if char not in self.pieces:
            move = (self.start, len(char.encode("utf-8", "surrogatepass")))
        else:
            grown = state.suffix + char
            # last[k], rel[k]: the last token before grown[k:], and the count there against the count here
            for k in range(len(grown) - 1, -1, -1):
                t = grown[k:]
                if t in self.pieces and self._follows(state.last[k], t):
                    break
            delta = state.rel[k] + 1
            # positions where no piece can start any more don't tell states apart
            live = [grown[k:] in self.prefixes for k in range(len(grown))] + [True]
            keep = live.index(True)
            last = tuple(u if on else None for u, on in zip((*state.last, t), live))[keep:]
            rel = tuple(r - delta if on else 0 for r, on in zip((*state.rel, delta), live))[keep:]
            rest = grown[keep:]
            key = (rest, tuple([self._sign(u, rest[k:]) for k, u in enumerate(last)]), rel)
            if (to := self.states.get(key)) is None:
                to = self.states[key] = _State(rest, last, rel)
            move = (to, delta)
        state.moves[char] = move
        return move

    def count_segment(self, segment: str) -> int:
        """Tokens of a text that starts in the start state."""
        if (n := self.memo.get(segment)) is not None:
            return n
        n, state = 0, self.start
        for char in segment:
            state, delta = state.moves.get(char) or self._move(state, char)
            n += delta
        if len(self.states) > MAX_STATES:
            self._restart()
        if len(self.memo) > MAX_MEMO:
            self.memo.clear()
        if len(segment) <= MEMO_CHARS:
            self.memo[segment] = n
        return n

    def _sum(self, segments: list[str]) -> int:
        try:  # known segments are one transition each
            return sum(map(self.memo.__getitem__, segments))
        except KeyError:
            return sum(map(self.count_segment, segments))

    def run(self, state: _State, texts: tuple[str, ...]) -> tuple[_State, int]:
        """The state after reading texts, and the tokens counted on the way."""
        n = 0
        for text in texts:
            for k in range(0, len(text), STRETCH):
                for char in text[k : k + STRETCH]:
                    state, delta = state.moves.get(char) or self._move(state, char)
                    n += delta
                if len(self.states) > MAX_STATES:
                    self._restart()
                    state = _bare(state)
        return state, n

    def chunk_map(self, chunk: str) -> StateMap:
        found = self.segments(chunk)
        if len(found) < 2:
            return StateMap((chunk,), 0, None)
        state, n = self.run(self.start, (found[-1],))
        return StateMap((found[0],), self._sum(found[1:-1]) + n, _bare(state))

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of two neighbouring chunks; associative."""
        if a.exit is None:
            return StateMap(a.heads + b.heads, b.inner, b.exit)
        state, n = self.run(a.exit, b.heads)
        return StateMap(a.heads, a.inner + n + b.inner, _bare(state) if b.exit is None else b.exit)

    def composed(self, maps: list[StateMap]) -> StateMap:
        """The map of all chunks, in a logarithmic number of parallel steps."""
        while len(maps) > 1:
            maps = [self.compose(maps[k], maps[k + 1]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def finish(self, whole: StateMap) -> int:
        """The count of a text from the map of all of it, applied to the start state."""
        return self.run(self.start, whole.heads)[1] + whole.inner

    def count(self, text: str | None, chunk_chars: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if len(marked) <= chunk_chars:
            return self._sum(self.segments(marked))
        maps = [self.chunk_map(marked[k : k + chunk_chars]) for k in range(0, len(marked), chunk_chars)]
        return self.finish(self.composed(maps))


def _bare(state: _State) -> _State:
    """The same state without the transitions made so far, so that it doesn't keep a dropped table."""
    return _State(state.suffix, state.last, state.rel)


_compiled: dict[str, TokenTransducer] = {}


def compiled(name: str, pieces: dict[str, float]) -> TokenTransducer:
    """The worker's machine for a vocabulary, kept from task to task."""
    if name not in _compiled:
        _compiled.clear()
        _compiled[name] = TokenTransducer(pieces)
    return _compiled[name]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids keep a
    row each; an empty table gives an empty result; other columns are left out.
    One pass without a shuffle: the vocabulary, bounded by the model file, goes to each
    task; every worker compiles its own machine as it reads.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_path, pieces.value)
        for batch in batches:
            texts = batch.column("text")
            counts = pa.array([machine.count(t.as_py()) for t in texts], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, counts, pc.greater(counts, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
