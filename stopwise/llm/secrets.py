"""Secret scans: candidates by pattern, false positives removed by a random forest.

1. Candidates are keyed values (``password = ...``), known key shapes, and long runs of key characters.
2. Features of a candidate: length and character classes, entropy, how usual its character transitions are
   and how much of it is covered by dictionary words (both counted over all whole texts, in Spark), whether it lies in a path or url, what the source's path says (test, example, docs), and the words before
   and after it.
3. A random forest (Spark ML) is trained on labelled findings and gives every candidate a probability.

Labelled findings come as a table. Where none exists, ``planted_findings`` makes one: in a bounded sample
of documents it plants values whose label is known by construction: drawn secrets of several shapes, and
look-alikes (checksums after "commit" or "sha", numbers, identifiers, words of the document itself,
placeholders, embedded data). Values and places are drawn from a seed.

Defined results: a null or empty text has no findings. Overlapping candidates are reported once, the
leftmost and longest, and whole: neither a value nor a run has a greatest length, and a PEM block goes up to
its END line. Repeated rows are scanned each. Positions count code points. A finding never holds
its value, only its place, kind, length and a digest. Extra columns are kept by ``redact`` and ignored by
``scan``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.sampling import smallest
from stopwise.llm.worker import released, sliced
from stopwise.session import local_frame, materialize

if TYPE_CHECKING:  # workers import this module and need no Spark ML, which takes 26 MB of each
    from pyspark.ml.classification import RandomForestClassificationModel

KEYED = r"(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)"
#: A PEM block up to its END line, or where it is cut off, up to the last line of key characters.
PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\s|\\[nr])++[0-9A-Za-z+/]{16,}+={0,2})*+)"
)
#: Shapes with a fixed mark.
SHAPES = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[0-9A-Za-z]{30,}",
    r"xox[abprs]-[0-9A-Za-z-]{10,}",
    r"sk-[0-9A-Za-z_-]{20,}",
    r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{4,}",
    PEM,
)
CANDIDATE = re.compile(
    rf"""(?P<keyed>{KEYED}['"]?\s{{0,3}}[:=]\s{{0,3}}["']?(?P<value>{PEM}|(?:(?!-----BEGIN )[^\s"'<>,;]){{6,}}+))"""
    rf"""|(?P<shape>{"|".join(SHAPES)})"""
    r"""|(?P<run>(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*[0-9])[0-9A-Za-z+/_-]{16,}+={0,2})"""
)
NEAR = 40
WORD = re.compile(r"[^\W\d_]{2,}")
SECRET_WORDS = re.compile(rf"{KEYED}|\bkey\b|(?i:private|bearer|login)")
OTHER_WORDS = re.compile(r"(?i:commit|sha\d*|md5|checksum|digest|hash|uuid|guid|version|build|invoice|order|card|phone|example|sample|dummy|test)")
EXAMPLE_PATH = re.compile(r"(?i)(?:^|[/_.-])(?:tests?|examples?|samples?|docs?|fixtures?|mocks?)(?:$|[/_.-])")
FEATURES = 20
#: Letters of a dictionary word.
SHORTEST, LONGEST = 3, 12
#: Kinds of rows of the language counts.
PAIR, KNOWN, ALL = range(3)
#: What a task counts at once: characters read, and distinct words.
HELD_CHARS, HELD_WORDS = 1 << 24, 50_000
SCHEMA = "doc_id long, start int, end int, kind string, length int, digest string, features array<double>"


@dataclass
class Language:
    """Character transitions and dictionary of ordinary text."""

    transitions: dict[str, float]
    words: frozenset[str]
    rare: float

    def usual(self, value: str) -> float:
        """Mean log probability of the value's letter transitions."""
        pairs = [value[i : i + 2].lower() for i in range(len(value) - 1)]
        return sum(self.transitions.get(p, self.rare) for p in pairs) / max(1, len(pairs))

    def covered(self, value: str) -> float:
        """Share of the value's characters in dictionary words of at least three letters, longest first."""
        low, i, hit = value.lower(), 0, 0
        while i < len(low):
            for n in range(min(LONGEST, len(low) - i), SHORTEST - 1, -1):
                if low[i : i + n] in self.words:
                    hit += n
                    i += n
                    break
            else:
                i += 1
        return hit / max(1, len(low))


def _language_counts(docs: DataFrame) -> DataFrame:
    """``lang, kind, key, n``: letter pairs and dictionary words of all texts, and all words per language.

    A task counts words before it sends them; pairs are taken from its distinct words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        chars = 0

        def flush() -> pa.RecordBatch:
            out = Counter()
            for lang, words in seen.items():
                for word, n in words.items():
                    low = word.lower()
                    for i in range(len(low) - 1):
                        out["", PAIR, low[i : i + 2]] += n
                    if SHORTEST <= len(low) <= LONGEST:
                        out[lang, KNOWN, low] += n
                out[lang, ALL, ""] += words.total()
            seen.clear()
            langs, kinds, keys = zip(*out) if out else ((), (), ())
            types = (pa.string(), pa.int32(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((langs, kinds, keys, list(out.values())), types)], ["lang", "kind", "key", "n"])

        for batch in sliced(batches, 0):
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                seen.setdefault(lang or "", Counter()).update(WORD.findall(text or ""))
                chars += len(text or "")
                if chars >= HELD_CHARS or sum(map(len, seen.values())) >= HELD_WORDS:
                    yield flush()
                    chars = 0
        yield flush()

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    counted = docs.select("text", lang.alias("lang")).mapInArrow(released(run), "lang string, kind int, key string, n long")
    return counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def learn_language(docs: DataFrame, words: int = 500_000) -> Language:
    """Statistics of all texts of ``docs``: every letter pair, and the words that are frequent in their language.

    With L languages a word is known if its share of the words of a language is at least L / ``words``. At
    most ``words`` / L words of one language can reach that share, so never more than ``words`` in all.
    Words over LONGEST letters are left out, as ``covered`` looks for none.
    """
    counts = materialize(_language_counts(docs), "language")
    totals = counts.where(F.col("kind") == ALL).select("lang", F.col("n").alias("of"))
    langs = totals.count()
    frequent = counts.where(F.col("kind") == KNOWN).join(totals, "lang").where(F.col("n") * F.lit(float(words)) >= F.col("of") * F.lit(float(langs)))
    known = frozenset(key for (key,) in frequent.select("key").distinct().collect())
    pairs = {r["key"]: r["n"] for r in counts.where(F.col("kind") == PAIR).select("key", "n").collect()}
    total = sum(pairs.values()) + 1
    return Language({p: math.log(n / total) for p, n in pairs.items()}, known, math.log(0.5 / total))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the value of each candidate, leftmost first."""
    for m in CANDIDATE.finditer(text):
        kind = m.lastgroup if m.lastgroup != "value" else "keyed"
        kind = "keyed" if m.group("value") else kind
        yield (*m.span("value"), kind) if kind == "keyed" else (*m.span(), kind)


def features(text: str, start: int, end: int, kind: str, source: str | None, language: Language) -> list[float]:
    value = text[start:end]
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    n = max(1, len(value))
    token = text[max(text.rfind(" ", max(0, start - 200), start), text.rfind("\n", max(0, start - 200), start)) + 1 : end]
    digits = sum(c.isdigit() for c in value)
    return [
        float(len(value)),
        digits / n,
        sum(c.isupper() for c in value) / n,
        sum(c.islower() for c in value) / n,
        sum(not c.isalnum() for c in value) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(digits == len(value)),
        entropy(value),
        sum(value[i].isdigit() != value[i + 1].isdigit() for i in range(len(value) - 1)) / n,
        len(set(value)) / n,
        language.usual(value),
        language.covered(value),
        float("/" in token or "\\" in token or "://" in token),
        float("." in value),
        float(bool(EXAMPLE_PATH.search(source or ""))),
        float(bool(SECRET_WORDS.search(before))),
        float(bool(OTHER_WORDS.search(before))),
        float(bool(re.search(r"[:=]\s{0,3}[\"']?$", before))),
        float(len(WORD.findall(before)) + len(WORD.findall(after))),
        {"run": 0.0, "keyed": 1.0, "shape": 2.0}[kind],
    ]


# Planted findings.

PUBLIC_WORDS = ("commit", "sha256:", "md5", "checksum", "build", "uuid", "invoice", "order", "card", "version", "phone", "id")


def _draw(rng: random.Random, text: str) -> tuple[str, str, int]:
    """(words before the value, value, label)."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    name = rng.choice(("token", "password", "secret", "api_key", "access_key", "auth_token", "pwd"))
    sign = rng.choice((" = ", "=", ": ", ' = "', '="'))
    base64 = letters + "+/"
    kind = rng.randrange(16)
    if kind == 0:
        return name + sign, some("0123456789abcdef", rng.choice((32, 40, 64))), 1
    if kind == 1:
        return name + sign, some(letters, rng.randint(16, 48)), 1
    if kind == 2:
        return rng.choice(("", "key ", name + sign)), "AKIA" + some(letters[26:], 16), 1
    if kind == 3:
        return rng.choice(("", name + sign)), rng.choice(("ghp_", "sk-", "xoxb-")) + some(letters, 36), 1
    if kind == 4:
        return name + sign, some(letters + "!#%&*+-_", rng.randint(8, 16)), 1
    if kind == 5:
        return rng.choice(("bearer ", "private key ", "login ")), some(letters, rng.randint(24, 40)), 1
    if kind == 12:
        token = ".".join(("eyJ" + some(letters + "_-", rng.randint(16, 40)), "eyJ" + some(letters + "_-", rng.randint(30, 500)), some(letters + "_-", rng.randint(20, 350))))
        return rng.choice(("", "bearer ", name + sign)), token, 1
    if kind == 13:
        lines = [some(base64, 64) for _ in range(rng.randint(1, 26))] + [some(base64, rng.randint(4, 60)) + "="]
        mark = rng.choice(("RSA ", "EC ", "OPENSSH ", "")) + "PRIVATE KEY-----"
        end = rng.choice(("\n", "\n", "\\n"))
        return rng.choice(("", "\n", name + sign)), end.join((f"-----BEGIN {mark}", *lines, f"-----END {mark}")), 1
    if kind == 14:
        return rng.choice(("key ", "private key ", name + sign)), some(base64, rng.randint(80, 700)) + rng.choice(("", "=", "==")), 1
    word = rng.choice(PUBLIC_WORDS) + " "
    if kind == 15:
        long = some(base64, rng.randint(80, 700)) + rng.choice(("", "=", "=="))
        return rng.choice(("data:image/png;base64,", "data:font/woff2;base64,", "checksum sha512-", "image ")), long, 0
    if kind == 6:
        return word, some("0123456789abcdef", rng.choice((32, 40, 64))), 0
    if kind == 7:
        return rng.choice((word, "")), some("0123456789", rng.randint(16, 20)), 0
    if kind == 8:
        hexes = some("0123456789abcdef", 32)
        return word, "-".join((hexes[:8], hexes[8:12], hexes[12:16], hexes[16:20], hexes[20:])), 0
    words = WORD.findall(text[:2000]) or ["plain"]
    if kind == 9:
        return rng.choice(("", "see /")), "-".join(rng.choice(words) for _ in range(rng.choice((4, 4, 12, 40)))) + f"-{rng.randrange(100)}", 0
    if kind == 10:
        return name + sign, rng.choice(("changeme", "xxxxxxxx", "<password>", "your_token_here", "example", "********", "${TOKEN}", "password1")), 0
    return name + rng.choice((": ", " = ")), rng.choice(words).lower() + rng.choice(words).lower(), 0


def planted_findings(docs: DataFrame, rows: int = 1500, each: int = 4, longest: int = 4000, seed: int = 11) -> list[tuple[str, str | None, int, int, str, int]]:
    """(text around, source, start, end, kind, label) of planted values.

    The sample is bounded: ``rows`` documents of at most ``longest`` characters, the smallest by a hash of the id.
    """
    short = docs.where(F.col("doc_id").isNotNull() & (F.char_length("text") <= longest) & (F.col("text") != ""))
    # ids first, then the texts of these few
    picked = smallest(short.select("doc_id").distinct(), "doc_id", rows, seed)
    chosen = local_frame(docs.sparkSession, picked, docs.select("doc_id").schema)
    found = short.select("doc_id", "text", F.col("source").cast("string").alias("source")).join(F.broadcast(chosen), "doc_id")
    sample = found.groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("r")).orderBy("doc_id").select("doc_id", "r.*").collect()
    out = []
    for row in sample:
        rng = random.Random(f"{seed}:{row['doc_id']}")
        gaps = [m.start() for m in re.finditer(r"\s", row["text"])] or [0]
        for _ in range(each):
            before, value, label = _draw(rng, row["text"])
            at = rng.choice(gaps)
            text = row["text"][max(0, at - 300) : at] + " " + before
            start = len(text)
            text += value + rng.choice(('"', "", ".")) + row["text"][at : at + 300]
            for s, e, kind in candidates(text):
                if s < start + len(value) and e > start:
                    out.append((text, row["source"], s, e, kind, label))
                    break
    return out


@dataclass
class Scanner:
    language: Language
    forest: RandomForestClassificationModel


def train(docs: DataFrame, findings: list[tuple] | None = None, trees: int = 30, depth: int = 8, seed: int = 11) -> Scanner:
    """Fit on labelled findings (text, source, start, end, kind, label), or on planted ones of ``docs``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark = docs.sparkSession
    labelled = findings if findings is not None else planted_findings(docs, seed=seed)
    language = learn_language(docs)
    rows = [(float(label), features(text, s, e, kind, source, language)) for text, source, s, e, kind, label in labelled]
    if len({label for label, _ in rows}) < 2:  # too little text to learn from: one clear case of each kind
        clear = (("token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 8, 48, "keyed", 1), ("card 4994226020900891 of", 5, 21, "run", 0))
        rows += [(float(y), features(t, s, e, k, None, language)) for t, s, e, k, y in clear]
    data = local_frame(spark, rows, "label double, raw array<double>").repartition(4)
    data = materialize(data, "findings").select("label", array_to_vector("raw").alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", cacheNodeIds=False).fit(data)
    return Scanner(language, forest)


def _judged(found: DataFrame, scanner: Scanner, threshold: float) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = scanner.forest.transform(found.withColumn("features", array_to_vector("features")))
    return scored.withColumn("score", vector_to_array("probability")[1]).withColumn("secret", F.col("score") >= threshold)


def scan(docs: DataFrame, scanner: Scanner, threshold: float = 0.5) -> DataFrame:
    """``doc_id, start, end, kind, length, digest, score, secret`` of every candidate."""
    language = docs.sparkSession.sparkContext.broadcast(scanner.language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.float64())]
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in sliced(batches):
            rows = []
            for doc, text, source in zip(*(c.to_pylist() for c in batch.columns)):
                for s, e, kind in candidates(text or ""):
                    digest = hashlib.sha256(text[s:e].encode("utf-8", "replace")).hexdigest()
                    rows.append((doc, s, e, kind, e - s, digest, features(text, s, e, kind, source, language.value)))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    found = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string")).mapInArrow(released(run), SCHEMA)
    return _judged(found, scanner, threshold).select("doc_id", "start", "end", "kind", "length", "digest", "score", "secret")


def redact(docs: DataFrame, scanner: Scanner, threshold: float = 0.5, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars``, if there, counted again.

    The forest's trees are sent to the tasks as plain thresholds, so a text is read and written in one pass.
    """
    plain = docs.sparkSession.sparkContext.broadcast((scanner.language, plain_trees(scanner.forest)))
    names = docs.columns
    text_at, source_at = names.index("text"), names.index("source") if "source" in names else -1
    count_at = names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, trees = plain.value
        for batch in sliced(batches, text_at):
            texts = batch.column(text_at).to_pylist()
            sources = batch.column(source_at).to_pylist() if source_at >= 0 else [None] * len(texts)
            changed = False
            for i, (text, source) in enumerate(zip(texts, sources)):
                spans = [
                    (s, e)
                    for s, e, kind in candidates(text or "")
                    if probability(trees, features(text, s, e, kind, None if source is None else str(source), language)) >= threshold
                ]
                if spans:
                    parts, last = [], 0
                    for s, e in spans:
                        parts += [text[last:s], mark]
                        last = e
                    texts[i] = "".join(parts) + text[last:]
                    changed = True
            if changed:
                columns = list(batch.columns)
                columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
                if count_at >= 0:
                    counts = [None if t is None else len(t) for t in texts]
                    columns[count_at] = pa.array(counts, pa.int64()).cast(batch.schema.field(count_at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(released(run), docs.schema)


def plain_trees(forest: RandomForestClassificationModel) -> list:
    """Each tree as nested (feature, threshold, left, right), a leaf as its probability of a secret."""

    def node(n):
        if n.subtreeDepth() == 0:
            counts = list(n.impurityStats().stats())
            return counts[1] / (counts[0] + counts[1])
        split = n.split()
        return split.featureIndex(), split.threshold(), node(n.leftChild()), node(n.rightChild())

    return [node(tree._call_java("rootNode")) for tree in forest.trees]


def probability(trees: list, row: list[float]) -> float:
    total = 0.0
    for tree in trees:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        total += tree
    return total / len(trees)
