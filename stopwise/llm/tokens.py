"""Token counts from a BPE vocabulary compiled to a deterministic transducer.

Compilation. The BPE encoding of a prefix of a text ends with one token that is fixed by the prefix,
and two tokens may stand side by side exactly when the encoding of their joined text is these two.
So the encoding of every prefix follows from left to right: at a position, the last token is the
vocabulary piece ending there that is compatible with the last token where it starts. Only pieces that
are suffixes of the text read so far matter, so what the future needs is: the longest suffix that begins
some piece, and for each position in it the last token and how many tokens fewer the prefix up to there has.
That is the transducer's state; there are finitely many. A transition on a character is annotated with the
change of the token count. States and transitions are compiled when first met and kept, up to a bound.

Words. No piece holds white space after another character, so a word's first character resets the state, as
does a character that is in no piece (it falls back to its bytes). A word's transitions add up to one count,
which is kept too (a bounded memo of macro transitions).

Long texts. Texts beyond ``CHUNK`` characters are cut into chunks that are dealt out over the cluster. A chunk's
state map sends an entry state to an exit state and a count: what comes before the first reset is kept as text,
the rest is a constant. Maps compose associatively, and a prefix scan in tree order over a text's maps gives
its count. States are carried between tasks in a form that holds in every process.

Defined results: a null or empty text has no tokens; white space is text like any other. Repeated rows are
counted each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CHUNK = 1 << 16
#: Words of at most so many characters are kept; entries and states after which a worker starts anew.
WORD_CHARS, WORDS, STATES = 48, 600_000, 300_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: A state: suffix read, last token at each position of it (None at a reset), tokens fewer than now.
State = tuple[str, tuple, tuple]
START: State = ("", (None,), (0,))


class Vocabulary:
    """Pieces and their merge order, read from a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            (model.get_score(i), model.id_to_piece(i))
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        normal.sort(key=lambda entry: -entry[0])
        self.rank = {piece: n for n, (_, piece) in enumerate(normal)}
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.known: dict[tuple[str, str], bool] = {}

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes the piece; None for a character, or when merging never ends in it."""
        if piece not in self.splits:
            parts, last = list(piece), None
            while len(parts) > 1:
                merges = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
                if not merges:
                    last = None
                    break
                _, i = min(merges)
                last = parts[i], parts[i + 1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.splits[piece] = last
        return self.splits[piece]

    def reachable(self, piece: str) -> bool:
        return len(piece) == 1 or self.split(piece) is not None

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging leaves a boundary between the two.

        Undo their merges, the later one first. While a and b are neighbours across the boundary, a
        merge of the two would have to come before the merge that uses one of them up.
        """
        key = left, right
        if key not in self.known:
            self.known[key] = self._compatible(left, right)
        return self.known[key]

    def _compatible(self, a: str, b: str) -> bool:
        when = lambda piece: self.rank[piece] if len(piece) > 1 else -1
        limit = len(self.rank)
        while True:
            across = self.rank.get(a + b)
            if across is not None and across < limit:
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            if when(a) > when(b):
                limit, a = when(a), self.split(a)[1]
            else:
                # of equal merges the left one comes first
                limit, b = when(b) + 1, self.split(b)[0]


class Transducer:
    """The vocabulary as a lazily compiled deterministic transducer."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.prefixes = {piece[:n] for piece in self.vocabulary.rank for n in range(1, len(piece) + 1)}
        self.characters = {c for piece in self.vocabulary.rank for c in piece}
        for piece in self.vocabulary.rank:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} spans words")
        cut = "\n" if "\n" not in self.characters else ""
        self.words = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" + "|\n+" * bool(cut)).findall
        self.memo: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[State, int] = {START: 0}
        self.states: list[State] = [START]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def number(self, state: State) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return found

    def _step(self, state: State, c: str) -> tuple[State, int]:
        suffix, lasts, fewer = state
        if c not in self.characters:
            return START, len(c.encode("utf-8", "replace"))
        if c == SPACE and suffix and suffix[-1] != SPACE:
            suffix, lasts, fewer = START
        grown = suffix + c
        while grown not in self.prefixes:
            grown = grown[1:]
            if not grown:
                break
        v = self.vocabulary
        for n in range(len(grown), 0, -1):
            piece = grown[len(grown) - n :]
            at = len(lasts) - n  # where the piece starts
            if piece in v.rank and v.reachable(piece) and (lasts[at] is None or v.compatible(lasts[at], piece)):
                gain, last = 1 - fewer[at], piece
                break
        else:  # a character that only occurs inside pieces: its bytes, and nothing merges with it
            return START, len(c.encode())
        lasts, fewer = (*lasts, last), (*(f + gain for f in fewer), 0)
        kept = len(grown) + 1
        return (grown, lasts[-kept:], fewer[-kept:]), gain

    def run(self, state: State, text: str) -> tuple[State, int]:
        """Exit state and change of the count for a text with white space already escaped."""
        if len(self.states) > STATES:
            self._clear()
            self.vocabulary.known.clear()
        at, count, moves = self.number(state), 0, self.moves
        for c in text:
            move = moves[at].get(c)
            if move is None:
                following, gain = self._step(self.states[at], c)
                move = moves[at][c] = self.number(following), gain
            at, gain = move
            count += gain
        return self.states[at], count

    def count_words(self, text: str) -> int:
        """Tokens of an escaped text that begins at a reset."""
        memo, total = self.memo, 0
        if len(memo) > WORDS:
            memo.clear()
        words = self.words(text)
        try:
            return sum([memo[word] for word in words])
        except KeyError:
            for word in words:
                count = memo.get(word)
                if count is None:
                    count = self.run(START, word)[1]
                    if len(word) <= WORD_CHARS:
                        memo[word] = count
                total += count
        return total

    def count(self, text: str) -> int:
        return self.count_words(escape(text)) if text else 0

    # State maps: (text before the first reset, tokens after it, exit state); the last is None without a reset.

    def state_map(self, chunk: str) -> tuple[str, int, State | None]:
        """The map of an escaped chunk whose entry state is not known."""
        found = re.search(f"(?<=[^{SPACE}]){SPACE}", chunk)
        if not found:
            return chunk, 0, None
        first = found.start()
        last = chunk.rfind(SPACE)
        while chunk[last - 1] == SPACE:  # the start of the last word's white space
            last -= 1
        state, count = self.run(START, chunk[last:])
        return chunk[:first], self.count_words(chunk[first:last]) + count, state

    def compose(self, a: tuple, b: tuple) -> tuple:
        """First ``a``, then ``b``."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, count = self.run(a[2], b[0])
        return a[0], a[1] + count + b[1], state if b[2] is None else b[2]

    def scan(self, maps: list[tuple]) -> int:
        """The count of a whole text: its maps composed in tree order, applied to the start state."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.run(START, maps[0][0])[1] + maps[0][1]


def escape(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def _portable(state: State | None) -> str | None:
    return None if state is None else json.dumps(state)


def _state(text: str | None) -> State | None:
    return None if text is None else (lambda s: (s[0], tuple(s[1]), tuple(s[2])))(json.loads(text))


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs`` (doc_id, text)."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = kept.where(F.char_length("text") <= chunk)
    # rows are told apart by a number of their own, as ids may repeat
    long = kept.where(F.char_length("text") > chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([t.count(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [text[i : i + chunk] for i in range(0, len(text), chunk)]
                n = len(parts)
                columns = [pa.array([doc] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "place", "text"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            rows = batch.to_pylist()
            found = [t.state_map(escape(r["text"]) if r["place"] == 0 else r["text"].replace(" ", SPACE)) for r in rows]
            columns = [
                *batch.columns[:3],
                pa.array([len(r["text"].encode()) for r in rows], pa.int64()),
                pa.array([m[0] for m in found], pa.string()),
                pa.array([m[1] for m in found], pa.int64()),
                pa.array([_portable(m[2]) for m in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "place", "n_bytes", "head", "n", "exit"])

    def scan(data: pa.Table) -> pa.Table:
        rows = data.sort_by("place").to_pylist()
        n = transducer(path).scan([(r["head"], r["n"], _state(r["exit"])) for r in rows])
        columns = [[rows[0]["doc_id"]], [sum(r["n_bytes"] for r in rows)], [n]]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "n_bytes", "n_tokens"), columns)})

    pieces = long.mapInArrow(cut, "doc_id long, row long, place int, text string")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mapped = pieces.repartition(parts, "row", "place").mapInArrow(
        maps, "doc_id long, row long, place int, n_bytes long, head string, n long, exit string"
    )
    return short.mapInArrow(count, SCHEMA).union(mapped.groupBy("row").applyInArrow(scan, SCHEMA))
