"""Toxicity of texts after noisy-channel restoration of disguised words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import KEY, keyed, stored

#: Labelled texts that are learned from, at most (those with the smallest hashes).
TRAIN_ROWS = 20_000
#: How surprising a feature's share of toxic texts must be (nats), and pseudo-texts at the
#: overall rate added to each.
SURPRISE, PRIOR = 10.0, 4.0
#: Words whose restoration a task remembers; it starts anew beyond that.
KNOWN_WORDS = 300_000

#: Letters of the character model (0 stands for anything else), and what
#: a character that is not a letter may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e",
    "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
#: Costs in nats: a substitute, a wildcard, a dropped separator, digit or repetition.
_SUBSTITUTE, _WILDCARD, _SEPARATOR, _DIGIT, _REPEAT = 1.5, 3.0, 1.5, 10.0, 0.5
#: A sign that may stand for a letter is rarely a mere separator.
_SIGN = 8.0
_SIZE = len(LETTERS) + 1
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_CODE = np.zeros(1 << 16, np.int32)
_CODE[[ord(c) for c in LETTERS]] = np.arange(1, _SIZE)
_EDGES = ".,;:!?\"'()[]{}«»…-–—"
_SIGNS = re.escape("".join(STANDS_FOR))
_GAP = r"[\s._-]+"
#: Single characters, letters or substitutes, with any white space or separators between.
_SPACED = re.compile(
    rf"(?<![^\s\"'(\[{{«.,;:…–—-])(?:(?:[^\W\d_]|[{_SIGNS}])[\s._*-]++)+(?:[^\W\d_]|[{_SIGNS}])(?!\w)"
)
_PART = re.compile(rf"{_GAP}|[^\s._-]")
_DOUBLE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")
#: Signs at the beginning of a word that are no letters.
_OPENING = "".join(c for c in _EDGES if c not in STANDS_FOR)


def trigram_counts(text: str) -> np.ndarray:
    """Counts of letter triples; both places before a word's first letter are the edge."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(raw < len(_CODE), _CODE[np.minimum(raw, len(_CODE) - 1)], 0)
    code = np.concatenate([[0, 0], code, [0]])
    before, last, now = code[:-2], code[1:-1], code[2:]
    before = np.where(last == 0, 0, before)
    use = (now > 0) | (last > 0)
    return np.bincount((before * _SIZE + last)[use] * _SIZE + now[use], minlength=_SIZE**3)


def fit_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a letter after two others, from the texts of all rows.

    Each task adds up its counts, so a few numbers a task are shuffled; the model has
    a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid:
                    total += trigram_counts(text.as_py())
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(code.astype(np.int64)), pa.array(total[code])], names=["code", "n"]
        )

    counted = (
        docs.select(F.col(text_col).cast("string").alias("text"))
        .mapInArrow(count, "code long, n long")
        .groupBy("code").agg(F.sum("n").alias("n"))
        .collect()
    )
    three = np.zeros(_SIZE**3)
    if counted:
        code, n = np.array([tuple(r) for r in counted], np.int64).T
        three[code] = n
    three = three.reshape(_SIZE, _SIZE, _SIZE)
    two = three.sum(axis=0)
    one = two.sum(axis=0) + 1
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def _arcs(token: str) -> list[list[tuple[int, str, float]]]:
    """What each character of a token may have been: (letter index, letter, cost)."""
    lattice, before = [], ""
    for c in token:
        if c in _INDEX:
            arcs = [(_INDEX[c], c, 0.0)]
            if c == before:
                arcs.append((-1, "", _REPEAT))
        elif c in STANDS_FOR:
            cost = _WILDCARD if len(STANDS_FOR[c]) > 2 else _SUBSTITUTE
            arcs = [(_INDEX[x], x, cost) for x in STANDS_FOR[c]]
            if c.isdigit():
                arcs.append((-1, "", _WILDCARD if c == before else _DIGIT))
            else:
                arcs.append((-1, "", _SIGN))
        elif c.isalnum():
            arcs = [(0, c, 0.0)]
        else:
            arcs = [(-1, "", _SEPARATOR)]
        lattice.append(arcs)
        before = c
    return lattice


#: A gap between characters, where a word may end.
_BREAK = [(-1, "", 0.0), (0, " ", 0.0)]


def _spaced_arcs(run: str) -> list[list[tuple[int, str, float]]]:
    """The lattice of a run of single characters: each gap may be a break between words."""
    lattice, before = [], ""
    for part in _PART.findall(run):
        if part[0].isspace() or part[0] in "._-":
            lattice.append(_BREAK)
        else:
            (arcs,) = _arcs(part)
            if part == before and part in _INDEX:
                arcs.append((-1, "", _REPEAT))
            lattice.append(arcs)
            before = part
    return lattice


def _spaced_runs(text: str) -> Iterator[re.Match]:
    """Runs of three single characters or more."""
    for run in _SPACED.finditer(text):
        if len(re.sub(_GAP, "", run.group())) > 2:
            yield run


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest word behind a token in lower case, by Viterbi over its lattice."""
    return _likeliest(_arcs(token), model)


def restore_spaced(run: str, model: np.ndarray) -> str:
    """The likeliest words, with a space between, behind a run of single characters."""
    return _likeliest(_spaced_arcs(run), model).strip()


_lists: dict[int, tuple[np.ndarray, list]] = {}


def _nested(model: np.ndarray) -> list:
    """The model as lists, in which single numbers are found faster."""
    if id(model) not in _lists:
        _lists.clear()
        _lists[id(model)] = model, model.tolist()
    return _lists[id(model)][1]


def _likeliest(lattice: list, model: np.ndarray) -> str:
    numbers = _nested(model)
    states = {(0, 0): (0.0, None)}
    for arcs in lattice:
        following: dict = {}
        for (a, b), (score, path) in states.items():
            after = numbers[a][b]
            for index, letter, cost in arcs:
                if index < 0:
                    key, s, p = (a, b), score - cost, path
                else:
                    key = (b, index) if index else (0, 0)
                    s, p = score - cost + after[index], (path, letter)
                known = following.get(key)
                if known is None or s > known[0]:
                    following[key] = (s, p)
        states = following
    path = max(
        ((score + numbers[a][b][0], i, path) for i, ((a, b), (score, path)) in enumerate(states.items())),
        key=lambda x: x[:2],
    )[2]
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def _undoubled(word: str, model: np.ndarray) -> str:
    """:func:`restore` of a word of letters in which some stand twice.

    Where single letters part the doubled ones, each is decided by its neighbours alone.
    """
    numbers, drop, last = _nested(model), [], -1
    for run in _RUN.finditer(word):
        i, end = run.span()
        if end - i > 2 or i <= last:
            return restore(word, model)
        last = end
        c = _INDEX.get(word[i])
        if c is None:
            continue
        a = _INDEX.get(word[i - 1], 0) if i else 0
        d = _INDEX.get(word[end], 0) if end < len(word) else 0
        if numbers[a][c][c] + numbers[c][c][d] + _REPEAT < numbers[a][c][d]:
            drop.append(i)
    if not drop:
        return word
    return "".join(c for i, c in enumerate(word) if i not in drop)


def meant(token: str, model: np.ndarray) -> tuple[str, ...]:
    """The words that a token in lower case may be, the likeliest first.

    A word of letters, none of them twice in a row, is its own only path.  Others go
    through their lattice; signs at the end of a token are none of its letters.  A word of
    letters counts as it stands, too.
    """
    plain = token.strip(_EDGES)
    inner = token.rstrip(_EDGES).lstrip(_OPENING)
    if inner == plain and plain.isalpha() and not _DOUBLE.search(plain):
        return (plain,)
    if inner == plain and plain.isalpha():
        restored = _undoubled(plain, model)
    else:
        restored = restore(inner, model) if inner else ""
    return (restored, plain) if plain.isalpha() and plain != restored else (restored,)


def words_of(text: str, model: np.ndarray, known: dict[str, str]) -> set[str]:
    """Distinct words of a text as they are meant; ``known`` remembers restored tokens.

    A token counts as it stands and as its lattice restores it; see :func:`meant`.  Runs
    of single characters have one lattice.
    """
    text = text.lower()
    found = set()
    for token in set(text.split()):
        words = known.get(token)
        if words is None:
            words = meant(token, model)
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[token] = words
        found.update(words)
    for run in _spaced_runs(text):
        found.update(restore_spaced(run.group(), model).split())
    found.discard("")
    return found


def restored_text(text: str, model: np.ndarray) -> str:
    """A text with its disguised words restored, its white space kept."""
    parts, at = [], 0
    for run in _spaced_runs(text):
        parts += [text[at : run.start()], restore_spaced(run.group().lower(), model)]
        at = run.end()
    joined = "".join([*parts, text[at:]])

    def one(match: re.Match) -> str:
        token = match.group()
        word = meant(token.lower(), model)[0]
        return token if word == token.lower().strip(_EDGES) else word

    return re.sub(r"\S+", one, joined)


def features_of(word: str) -> list[str]:
    """A word, and its beginnings of five and four letters."""
    out = [word]
    if len(word) > 5:
        out.append(word[:5] + "-")
    if len(word) > 4:
        out.append(word[:4] + "-")
    return out


@dataclass
class ToxicityModel:
    characters: np.ndarray
    rate: float
    #: Chance that a feature makes a text toxic, over the overall rate.
    lexicon: dict[str, float] = field(default_factory=dict)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    characters: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = TRAIN_ROWS,
) -> ToxicityModel:
    """Learns a lexicon of restored words and beginnings from ``rows`` labelled texts.

    Equal texts count once, as toxic if one of them is.  They are chosen by their hashes;
    texts are fetched for the chosen ones only.  Features are counted by Spark; those
    that stand in far more toxic texts than the overall rate would have it make the
    lexicon.  Without texts of both labels it stays empty.
    """
    hashed = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    ).filter("text is not null").withColumn("h", F.xxhash64("text"))
    known = labels.select(
        F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic")
    ).filter("toxic is not null")
    some = (
        hashed.select("id", "h").join(known, F.col("id") == F.col("label_id"))
        .groupBy("h").agg(F.max("toxic").alias("toxic")).orderBy("h").limit(rows)
    )
    some = stored(some, "sample")
    # ``rows`` numbers at most.
    chosen = hashed.select("h", "text").join(F.broadcast(some), "h")
    sample = stored(chosen.dropDuplicates(["h"]).select("text", "toxic"), "sample-texts")
    n, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    rate = (toxic or 0) / n if n else 0.0
    if not 0 < rate < 1:
        return ToxicityModel(characters, rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            names, labels = [], []
            for text, label in zip(batch.column("text"), batch.column("toxic"), strict=True):
                words = words_of(text.as_py(), characters, known)
                features = {f for w in words for f in features_of(w)}
                names += features
                labels += [label.as_py()] * len(features)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(labels, pa.int32())],
                names=["feature", "toxic"],
            )

    share = F.col("a") / F.col("n")
    clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    surprise = F.col("n") * (share * F.log(share / rate) + clean)
    chance = (F.col("a") + PRIOR * rate) / (F.col("n") + PRIOR)
    counted = stored(
        sample.mapInArrow(count, "feature string, toxic int")
        .groupBy("feature").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
        .select("feature", "n", "a"),
        "features",
    )
    telling = (F.col("a") > rate * F.col("n")) & (surprise >= SURPRISE)
    lexicon = {
        r[0]: r[1]
        for r in counted.filter(telling)
        .select("feature", ((chance - rate) / (1 - rate)).alias("e")).filter("e > 0.25").collect()
    }
    # Words and longer beginnings that say nothing, where a shorter beginning would.
    short = sorted({f[:4] for f in lexicon if f.endswith("-")})
    neutral = (
        counted.filter(F.substring("feature", 1, 4).isin(short) & ~telling & (F.col("n") > 1))
        .select("feature").collect()
        if short
        else []
    )
    return ToxicityModel(characters, rate, {r[0]: 0.0 for r in neutral} | lexicon)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text_key, score, found)`` of each row, from its whole text.

    Each restored word counts with its longest feature in the lexicon, each feature once; independent chances are combined.  ``found`` has the restored words that
    counted.  Null and empty texts have the score of no evidence.  Repeated rows get the
    same result; other columns are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        lexicon = model.lexicon
        beginnings = {f[:4] for f in lexicon}
        for batch in batches:
            scores, founds = [], []
            for text in batch.column("text"):
                best: dict[str, float] = {}
                found = []
                words = words_of(text.as_py(), model.characters, known) if text.is_valid else ()
                for word in words:
                    if word[:4] not in beginnings:
                        continue
                    feature = next((f for f in features_of(word) if f in lexicon), None)
                    e = lexicon.get(feature, 0.0)
                    if e:
                        best[feature] = e
                        found.append(word)
                rest = 1.0
                for e in best.values():
                    rest *= 1 - e
                scores.append(min(1.0, max(0.0, 1 - (1 - model.rate) * rest)))
                founds.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"),
                    pa.array(scores, pa.float64()), pa.array(founds, pa.list_(pa.string())),
                ],
                names=["doc_id", "text_key", "score", "found"],
            )

    return keyed(docs, id_col, text_col).mapInArrow(
        score, "doc_id long, text_key long, score double, found array<string>"
    )


def restore_texts(
    docs: DataFrame, characters: np.ndarray, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text_key, text)`` with disguised words restored; null stays null."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                restored_text(t.as_py(), characters) if t.is_valid else None
                for t in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in KEY), pa.array(texts, pa.string())],
                names=[*KEY, "text"],
            )

    return keyed(docs, id_col, text_col).mapInArrow(
        change, "doc_id long, text_key long, text string"
    )
