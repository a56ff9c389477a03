"""Token counts by a finite-state transducer compiled from a tokenizer's vocabulary.

The tokenizer merges adjacent pieces in order of their score. Of such a tokenizer two
things are known: a row of tokens is the encoding of its text if every two neighbours
are the encoding of theirs; so the encoding of a prefix is that of a shorter prefix and
one last token. Reading a character therefore needs only the *live* ends of what was
read, those that some piece may still continue, and for each the token before it and
how many tokens lie behind. That is the transducer's state. A transition picks the one
live end that, with the new character, is a token agreeing with the token before it,
and is annotated with the change in the number of tokens (below 0 where tokens fuse).

States are compiled when first reached and kept per worker process, up to a bound on
transitions; beyond it all are dropped and compiled anew. No piece holds certain pairs
of characters ("e" before a space, say). After such a pair the state depends on the
last character alone.

Long texts are cut into chunks that are dealt over the cluster. The state before a
chunk is then unknown, so a chunk gives a *state map*: for every state, the state after
it and the tokens emitted. Up to the first such pair the map is run per state, from
there on it is one count and one state. Maps compose associatively; a scan composes
neighbours level by level until one map per text is left.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import only, received, share, slices
from caseflow.sources.scratch import stage

SPACE = "▁"  # FIXED: how this kind of tokenizer writes a space
LIMIT = 4096
CHUNK = 1 << 16  # characters: longer texts are dealt out in chunks
FAN_IN = 64
TRANSITIONS = 400_000
FEW = 16  # pieces: up to so many possible ones are compared with the token before them
SHORT = 64  # characters: words up to here are remembered
INFINITE = 1 << 62


class State(dict):
    """Character -> (next state, change of count), filled when first asked for."""

    __slots__ = ("live", "machine")

    def __missing__(self, char: str) -> tuple[State, int]:
        return self.machine.extend(self, char)


def merges(text: str, pieces: dict[str, tuple[int, str, str]]) -> Iterator[list[str]]:
    """Tokens of a few characters, after every merge; of equal ranks the leftmost is merged."""
    tokens = list(text)
    while True:
        yield list(tokens)
        due = [(pieces[t][0], i) for i in range(len(tokens) - 1) if (t := tokens[i] + tokens[i + 1]) in pieces]
        if not due:
            return
        i = min(due)[1]
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


class Machine:
    """The transducer for a vocabulary given as piece -> (rank in merging, its two parts).

    Single characters have rank -1 and no parts.
    """

    def __init__(self, pieces: dict[str, tuple[int, str, str]], most: int = TRANSITIONS):
        self.pieces, self.most = pieces, most
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        ranks = Counter(rank for rank, *_ in pieces.values() if rank >= 0)
        self.tied = {p[i : i + 2] for p, (rank, *_) in pieces.items() if ranks[rank] > 1 for i in range(len(p) - 1)}
        self.longer: dict[str, list[str]] = {}
        for p in pieces:
            for i in range(1, len(p)):
                self.longer.setdefault(p[:i], []).append(p)
        self.known: dict[str, int] = {}
        entangled = "".join({SPACE, *(p[0] for p in self.pairs if p[1] == SPACE)})
        self.words = re.compile(f"(?<=[^{re.escape(entangled)}])(?={SPACE})")
        self.states: dict[tuple, State] = {}
        self.transitions = 0
        self.start = self.state((("", None, 0),))

    def state(self, live: tuple) -> State:
        """The state of these live ends: (characters, what lies before, tokens behind)."""
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = State()
            found.live, found.machine = live, self
        return found

    def agree(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart when encoded together.

        They do not if, at some time, the last part of the left one as merged so far and
        the first part of the right one make a piece that is due before either is merged
        further; of equal pieces the leftmost is made first. Undoing the later merge of
        the two step by step visits every pair of parts that are ever neighbours. Where
        different pieces share a rank, the two are encoded instead.
        """
        if left[-1] + right[0] in self.tied:
            *_, tokens = merges(left + right, self.pieces)
            return tokens == [left, right]
        pieces, left_until, right_until = self.pieces, INFINITE, INFINITE
        while True:
            fused = pieces.get(left + right)
            if fused is not None and fused[0] < left_until and fused[0] <= right_until:
                return False
            (left_rank, _, tail), (right_rank, head, _) = pieces[left], pieces[right]
            if left_rank < 0 and right_rank < 0:
                return True
            if left_rank >= right_rank:
                left, left_until = tail, left_rank
            else:
                right, right_until = head, right_rank

    def kind(self, end: str, before: str | None) -> str | frozenset | None:
        """What the token before a live end means for its future.

        None where it agrees with every piece that begins so, the empty set where it
        agrees with none (the end is dead), else the set of those it agrees with; the
        token itself while they are still many.
        """
        if before is None or before[-1] + end[0] not in self.pairs:
            return None
        longer = self.longer[end]
        if len(longer) > FEW:
            return before
        agreeing = frozenset(p for p in longer if self.agree(before, p))
        return None if len(agreeing) == len(longer) else agreeing

    def fits(self, end: str, before: str | frozenset | None, token: str) -> bool:
        if isinstance(before, frozenset):
            return token in before
        return before is None or before[-1] + token[0] not in self.pairs or self.agree(before, token)

    def extend(self, state: State, char: str) -> tuple[State, int]:
        if self.transitions >= self.most:
            for old in self.states.values():
                old.clear()
            self.states = {self.start.live: self.start}
            self.transitions = 0
        token, change = None, 0
        for end, before, behind in state.live:
            grown = end + char
            if grown in self.pieces and self.fits(end, before, grown):
                token, change = grown, behind + 1
                break
        if token is None:  # a character that is no piece is spelled in bytes
            change = len(char.encode("utf-8"))
        live = []
        for end, before, behind in state.live:
            grown = end + char
            if grown in self.longer:
                if isinstance(before, frozenset):
                    before = before.intersection(self.longer[grown])
                    before = None if len(before) == len(self.longer[grown]) else before
                else:
                    before = self.kind(grown, before)
                if before is None or before:
                    live.append((grown, before, behind - change))
        live.append(("", token, 0))
        self.transitions += 1
        state[char] = found = self.state(tuple(live)), change
        return found

    def run(self, state: State, text: str) -> tuple[State, int]:
        count = 0
        for char in text:
            state, change = state[char]
            count += change
        return state, count

    def count(self, text: str) -> int:
        """Tokens of a text. Cut before every space that no piece joins to what precedes
        it, each part starts anew, so its state map is a constant; those are remembered."""
        total, known = 0, self.known
        for word in self.words.split(written(text)):
            count = known.get(word)
            if count is None:
                count = self.run(self.start, word)[1]
                if len(word) <= SHORT:
                    if len(known) >= self.most:
                        known.clear()
                    known[word] = count
            total += count
        return total

    # -- state maps: (characters run per state, None or (count, state) of all that follows)

    def state_map(self, chunk: str) -> tuple:
        pairs = self.pairs
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in pairs:
                state, count = self.run(self.start, chunk[i:])
                return chunk[:i], (count, state)
        return chunk, None

    def compose(self, first: tuple, then: tuple) -> tuple:
        """The map of reading what ``first`` read and after it what ``then`` read."""
        if first[1] is None:
            return first[0] + then[0], then[1]
        count, state = first[1]
        state, more = self.run(state, then[0])
        if then[1] is None:
            return first[0], (count + more, state)
        return first[0], (count + more + then[1][0], then[1][1])

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix compositions in a logarithmic number of levels."""
        out, step = list(maps), 1
        while step < len(out):
            out = out[:step] + [self.compose(out[i - step], out[i]) for i in range(step, len(out))]
            step *= 2
        return out

    def reduce(self, maps: list[tuple]) -> tuple:
        """The composition of all, neighbours in pairs."""
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def apply(self, one: tuple, state: State | None = None) -> int:
        """Tokens emitted by a map from a state, the start unless given."""
        after, count = self.run(state or self.start, one[0])
        return count + (one[1][0] if one[1] else 0)

    def packed(self, one: tuple) -> str:
        return json.dumps([one[0], one[1] and [one[1][0], one[1][1].live]], default=sorted)

    def unpacked(self, text: str) -> tuple:
        head, rest = json.loads(text)
        return head, rest and (rest[0], self.state(tuple((e, frozenset(b) if isinstance(b, list) else b, n) for e, b, n in rest[1])))


def written(text: str) -> str:
    """The text as the tokenizer sees it: spaces as a letter of their own, one before all."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def read_pieces(path: str) -> dict[str, tuple[int, str, str]]:
    """The normal pieces of a vocabulary file: when each is merged, and of which two.

    Refuses a vocabulary this compiler does not cover: one that rewrites characters,
    lacks bytes to fall back on, or has pieces that merging does not reach in order.
    """
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    ids = range(processor.get_piece_size())
    every = "".join(chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    if processor.normalize(every + "  e\u0301 ") != written(every + "  e\u0301 "):
        raise ValueError(f"{path}: this vocabulary rewrites characters")
    if sum(map(processor.is_byte, ids)) != 256:
        raise ValueError(f"{path}: no bytes to fall back on")
    special = (processor.is_control, processor.is_unknown, processor.is_byte, processor.is_unused)
    scores = {processor.id_to_piece(i): processor.get_score(i) for i in ids if not any(f(i) for f in special)}
    rank = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
    pieces = {p: (rank[score] if len(p) > 1 else -1, "", "") for p, score in scores.items()}
    for piece in [p for p in pieces if len(p) > 1]:
        *_, parts, whole = merges(piece, pieces)
        if len(whole) > 1 or any(pieces.get(p, (INFINITE,))[0] > pieces[piece][0] for p in parts):
            raise ValueError(f"{path}: merging does not reach {piece!r} in order")
        pieces[piece] = (pieces[piece][0], *parts)
    return pieces


def machine_of(sent: Broadcast) -> Machine:
    """The worker process's own machine, compiled further by every task it runs."""
    if "machine" not in vars(sent):
        sent.machine = Machine(received(sent))
    return sent.machine


def token_counts(docs: DataFrame, vocabulary_path: str, *, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """Bytes and tokens of every row's ``text``, and whether the tokens exceed ``limit``.

    ``docs`` needs ``doc_id`` and ``text``; the result has doc_id, n_bytes, n_tokens and
    over_limit. A null text counts as empty, an empty one has no tokens. Null doc_ids are
    kept, repeated rows stay repeated, further columns are ignored, an empty table gives
    an empty one. Strings of control tokens inside a text are ordinary text.

    Texts of up to ``chunk`` characters are counted where they are read. Longer ones are
    dealt out by chunk and put together by the scan. The counts and those chunks are
    written once in between.
    """
    sent = share(docs.sparkSession, read_pieces(vocabulary_path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, context, row = machine_of(sent), TaskContext.get(), 0
        for part in slices(batches, "text"):
            took, counts, size, long_key, number, chunks = [], [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                text, row = text or "", row + 1
                cuts = [None] if len(text) <= chunk else [text[a : a + chunk] for a in range(0, len(text), chunk)]
                n_bytes, n_tokens = len(text.encode("utf-8")), machine.count(text) if cuts == [None] else None
                for n, cut in enumerate(cuts):
                    took.append(i), counts.append(n_tokens), size.append(n_bytes), number.append(n)
                    long_key.append(None if cut is None else (context.partitionId() << 40) + row)
                    chunks.append(cut)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(took, pa.int64())), pa.array(size, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(long_key, pa.int64()), pa.array(number, pa.int32()), pa.array(chunks, pa.string())],
                ["doc_id", "n_bytes", "n_tokens", "key", "no", "chunk"],
            )

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(sent)
        for part in slices(batches, "chunk"):
            found = []
            for n, text in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                text = written(text) if n == 0 else text.replace(" ", SPACE)
                found.append(machine.packed(machine.state_map(text)))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(found, pa.string())], names)

    def compose(group: pa.Table) -> pa.Table:
        machine = machine_of(sent)
        group = group.sort_by("no")
        one = machine.reduce([machine.unpacked(m) for m in group["map"].to_pylist()])
        first = group.slice(0, 1)
        number = pa.array([first["no"][0].as_py() // FAN_IN], pa.int32())
        return pa.table([*first.columns[:3], number, pa.array([machine.packed(one)])], names=names)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(sent)
        for part in batches:
            total = [machine.apply(machine.unpacked(m)) for m in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(total, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = f"doc_id {kind}, n_bytes long, n_tokens long"
    mapped, names = f"doc_id {kind}, n_bytes long, key long, no int, map string", ["doc_id", "n_bytes", "key", "no", "map"]
    read_once = stage(only(docs, "doc_id", "text").mapInArrow(read, f"{counted}, key long, no int, chunk string"))
    out = read_once.where("key IS NULL").select("doc_id", "n_bytes", "n_tokens")
    pieces = read_once.where("key IS NOT NULL")
    last = pieces.agg(F.max("no")).first()[0]
    if last is not None:
        pieces = pieces.select("doc_id", "n_bytes", "key", "no", "chunk").repartition("key", "no").mapInArrow(maps, mapped)
        while last:  # at most a few times: a text has up to 2^31 bytes
            pieces = pieces.groupBy("key", F.floor(F.col("no") / FAN_IN).alias("part")).applyInArrow(compose, mapped)
            last //= FAN_IN
        out = out.union(pieces.mapInArrow(close, counted))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
