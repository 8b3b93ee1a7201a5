"""BPE with word ends, encoded by a depth-first traversal of a trie of distinct words.

A merge table makes every string's encoding unique: it is the only cut into tokens in which no merge
crosses a boundary of two neighbours. A prefix's encoding is therefore settled by its last token, and
that of a longer prefix follows: its last token t is the one vocabulary entry at its end whose boundary
with the last token of what stands before t holds. So

1. texts are normalised and cut into words; only distinct words are encoded;
2. the distinct words of a buffer go into a trie in sorted order, which is its depth-first order; the
   path from the root to the current node is all of the trie that is held;
3. each node gets the last token of its prefix, once for all words below it; a word's ids are read
   backwards over the last tokens of its path;
4. a word's last letter carries the word end, so it has an alphabet of its own.

``Merges.crossing`` decides a boundary: the right edge of one token and the left edge of the next are
undone merge by merge, and a merge of two edge parts happens first if its rank is below that of the
merges that took the parts in (equal ranks merge from the left).

Normalisation follows the file: NFC, lower case letter by letter, white space only separates. Texts with
letters of scripts that newer Unicode versions still extend are normalised and cut by the tokenizers
library itself, since its tables and Python's differ there.

Defined results: a null text counts as empty; an empty text has no ids, its digests are those of the
empty string; special tokens inside a text are single ids, as in the library by default; rows are
independent, so repeated rows give repeated results; a null id stays null; columns other than the id and
the text are ignored; an empty table gives an empty result. Texts are read in windows that end before
white space, so memory doesn't grow with a text but only with its longest word.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.worker import released, sliced

SUFFIX = "</w>"
#: Characters of text whose distinct words make one trie; a longer text is read in windows of about this size.
BUFFER_CHARS = 1_000_000
#: Words kept in a worker's memo up to this length, and its characters (40 more a word) after which it starts anew.
MEMO_WORD, MEMO_CHARS = 48, 20_000_000
PAIR_MEMO = 500_000
NEVER = 1 << 30
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Blocks where Unicode versions after 15.0 add letters or marks (and rare scripts around them).
CHANGING = re.compile("[՘֋֌ࠀ-῿₀-₟ꀀ-꯿\U00010000-\U0001efff\U0001fb00-\U0010ffff]")
_GAP = re.compile(r"[ \t\n\r]")


def byte_letters() -> list[str]:
    """One printable letter for each byte: the byte's own where it prints, else the next ones from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def shared_letters(ordered: list[str], width: int = 32, rows: int = 20_000) -> Iterator[int]:
    """Letters that each word shares with the one before it."""
    last = ""
    for first in range(0, len(ordered), rows):
        part = [last, *ordered[first : first + rows]]
        letters = np.array(part, f"U{width}").view(np.uint32).reshape(-1, width)
        same = (letters[1:] == letters[:-1]) & (letters[1:] != 0)
        for i, shared in enumerate(np.where(same.all(1), width, same.argmin(1)).tolist()):
            yield shared if shared < width else len(commonprefix(part[i : i + 2]))
        last = part[-1]


class Merges:
    """Tokens by id, how each is made, and which neighbours stay apart."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        self.text: list[str] = [""] * size
        for token, number in vocab.items():
            self.text[number] = token
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            if max(self.rank[pair[0]], self.rank[pair[1]]) >= rank or self.parts[made] is not None:
                raise ValueError("a merge must follow those of its parts, and make a token of its own")
            self.rank[made], self.parts[made], self.merge[pair] = rank, pair, rank
        self.memo: dict[int, bool] = {}
        self.inner: dict[str, int] = {}
        self.outer: dict[str, int] = {}
        usable = [False] * size
        for token, number in sorted(vocab.items(), key=lambda item: self.rank[item[1]]):
            made = self.parts[number]
            # a token that merges never give, as one of an earlier rank comes between, ends no prefix
            usable[number] = made is None or usable[made[0]] and usable[made[1]] and self.crossing(*made) == self.rank[number]
            if usable[number]:
                if token.endswith(SUFFIX) and token != SUFFIX:
                    self.outer[token[: -len(SUFFIX)]] = number
                else:
                    self.inner[token] = number
        self.width = [len(t.removesuffix(SUFFIX)) if t != SUFFIX else len(t) for t in self.text]
        #: what a token can begin with: the longest such end of a prefix tells which tokens it may end with
        self.heads = {token[:n] for token in (*self.inner, *self.outer) for n in range(len(token) + 1)}
        self.ends: dict[str, tuple[list, list]] = {}

    def crossing(self, left: int, right: int) -> int:
        """Rank of the first merge across the boundary of two neighbours, NEVER if there is none."""
        first, merge, parts, rank = NEVER, self.merge, self.parts, self.rank
        a, a_until = left, NEVER
        while True:
            b, b_until = right, NEVER
            while True:
                found = merge.get((a, b))
                if found is not None and found < first and found < a_until and found <= b_until:
                    first = found
                made = parts[b]
                if made is None:
                    break
                b, b_until = made[0], rank[b]
            made = parts[a]
            if made is None:
                return first
            a, a_until = made[1], rank[a]

    def apart(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) >= PAIR_MEMO:
                self.memo.clear()
            found = self.memo[key] = self.crossing(left, right) == NEVER
        return found

    def candidates(self, head: str) -> tuple[list, list]:
        """(width, token) of the tokens that ``head`` ends with, longest first: inside a word, and at its end."""
        found = self.ends.get(head)
        if found is None:
            tails = [(width, head[len(head) - width :]) for width in range(len(head), 0, -1)]
            found = self.ends[head] = tuple([(w, tokens[t]) for w, t in tails if t in tokens] for tokens in (self.inner, self.outer))
        return found

    def last(self, end: int, path: list[int], candidates: list[tuple[int, int]]) -> int:
        """Last token of a prefix of ``end`` letters, given those of its shorter prefixes."""
        memo = self.memo
        for width, token in candidates:
            if width == end:
                return token
            apart = memo.get(path[end - width - 1] << 32 | token)
            if apart or apart is None and self.apart(path[end - width - 1], token):
                return token
        raise ValueError("a letter of the word is no token")

    def traverse(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words; nodes of the trie are visited depth first, each once."""
        heads, width, ends = self.heads, self.width, self.ends
        # last tokens of the prefixes on the way to the current node, and the head that each ends with
        path: list[int] = []
        tails: list[str] = []
        ordered = sorted(words)
        for word, shared in zip(ordered, shared_letters(ordered)):
            del path[shared:], tails[shared:]
            size = len(word)
            head = tails[-1] if tails else ""
            for end in range(len(path) + 1, size + 1):
                head += word[end - 1]
                while head not in heads:
                    head = head[1:]
                if end < size:
                    path.append(self.last(end, path, (ends.get(head) or self.candidates(head))[0]))
                    tails.append(head)
            ids = [self.last(size, path, self.candidates(head)[1])]
            at = size - width[ids[0]]
            while at:
                ids.append(path[at - 1])
                at -= width[ids[-1]]
            yield word, ids[::-1]


class Codec:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], [step["type"] for step in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        known = model["type"] == "BPE" and model["end_of_word_suffix"] == SUFFIX and steps == ["NFC", "Replace", "Lowercase"]
        if not known or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True):
            raise ValueError(f"{path} is no lower-case BPE with word ends")
        self.path = path
        self.merges = Merges(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.letters = byte_letters()
        self.numbers = [str(i) for i in range(len(self.merges.text))]
        self.names = {number: token for token, number in self.special.items()}
        self.library = None
        self.start()

    def start(self) -> None:
        """An empty memo: word to its decimal ids and its tokens' text, both joined by blanks."""
        self.memo = {token: (str(number), token) for token, number in self.special.items()}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens in order."""
        if "<" not in text or len(parts := self.special_cut.split(text)) == 1:
            return self.plain(text)
        found = []
        for i, part in enumerate(parts):
            found += [part] if i % 2 else self.plain(part)
        return found

    def plain(self, text: str) -> list[str]:
        if CHANGING.search(text):
            return self.by_library(text)
        return self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            with open(self.path, encoding="utf-8") as file:
                pattern = json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.library = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        normalizer, split = self.library
        return [piece for piece, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]

    def learn(self, words: set[str]) -> None:
        letters, merges = self.letters, self.merges
        spelled = {w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]): w for w in words}
        text, numbers = merges.text, self.numbers
        for spelling, ids in merges.traverse(spelled):
            self.memo[spelled[spelling]] = " ".join([numbers[i] for i in ids]), " ".join([text[i] for i in ids])
        self.held += sum(map(len, words)) + 40 * len(words)

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        self.learn(set(pieces) - self.memo.keys())
        return [int(i) for piece in pieces for i in self.memo[piece][0].split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.names.get(i) or self.merges.text[i] for i in ids])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: token count, digest of the decimal ids and of the decoded text."""
        state = [[0, hashlib.sha256(), hashlib.sha256()] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for row, text in enumerate(texts):
            for window in windows(text):
                waiting.append((row, self.pieces(window)))
                size += len(window)
                if size >= BUFFER_CHARS:
                    self.drain(waiting, state)
                    waiting, size = [], 0
        self.drain(waiting, state)
        return [(n, ids.hexdigest(), raw.hexdigest()) for n, ids, raw in state]

    def drain(self, waiting: list[tuple[int, list[str]]], state: list[list]) -> None:
        if self.held > MEMO_CHARS:
            self.start()
        self.learn(set().union(*(pieces for _, pieces in waiting)) - self.memo.keys())
        memo = self.memo
        for row, pieces in waiting:
            if pieces:
                own = state[row]
                gap = " " if own[0] else ""
                found = [memo[piece] for piece in pieces]
                ids = gap + " ".join([f[0] for f in found])
                own[0] += ids.count(" ") + (not gap)
                own[1].update(ids.encode())
                own[2].update((gap + " ".join([f[1] for f in found])).encode())
        for word in [word for word in memo if len(word) > MEMO_WORD and word not in self.special]:
            self.held -= len(word) + 40
            del memo[word]


def windows(text: str) -> Iterator[str]:
    """A text in parts of about BUFFER_CHARS that begin with white space, so no word is cut."""
    first = 0
    while len(text) - first > BUFFER_CHARS:
        gap = _GAP.search(text, first + BUFFER_CHARS)
        if gap is None:
            break
        yield text[first : gap.start()]
        first = gap.start()
    yield text[first:]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def forget() -> None:
    """Drop what the texts of a task left in the memos."""
    for c in _CODECS.values():
        c.start()
        c.merges.memo.clear()


def _map(docs: DataFrame, path: str, rows, schema: str, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in sliced(batches):
            yield rows(c, part.column(0), part.column(1))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run, forget), schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""

    def rows(c: Codec, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        found = [c.encode(text or "") for text in texts.to_pylist()]
        return pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _map(docs, path, rows, "doc_id long, ids array<int>", id_col, text_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of every id list, tokens joined by blanks; a null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kept = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return kept.mapInArrow(released(run, forget), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, keeping digests only (see SCHEMA)."""

    def rows(c: Codec, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        found = c.digests([text or "" for text in texts.to_pylist()])
        n, first, second = zip(*found) if found else ((), (), ())
        columns = [ids, pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _map(docs, path, rows, SCHEMA, id_col, text_col)
