"""Secrets in texts: candidates, and a random forest that sorts out false ones.

DataFrame and SQL operations only, the forest from ``pyspark.ml`` included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import KEY, keyed, stored

#: Labelled findings that are learned from, at most (those with the smallest hashes).
TRAIN_ROWS = 20_000
#: A word of the dictionary is in this share of all texts at least, and in texts of so many
#: of 64 classes by hash: copies of a text are in one class, so they make no word.
MIN_SHARE, MIN_CLASSES = 1e-3, 8
TREES, DEPTH, SEED = 24, 6, 7

#: Formats that tell a secret by themselves, words beside a secret, and what
#: looks like one but is not.
KNOWN_FORMATS = {
    "aws_access_key": r"^AKIA[0-9A-Z]{16}$",
    "github_token": r"^gh[pousr]_[A-Za-z0-9]{36}$",
    "slack_token": r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "google_api_key": r"^AIza[0-9A-Za-z_-]{35}$",
    "json_web_token": r"^eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+$",
}
SECRET_WORDS = r"(?i)(?:^|[^a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|private[_-]?key|credential)s?(?:$|[^a-z])"
NOT_SECRET = {
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}\W*$",
    "ip_address": r"^\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\W*$",
    "number": r"^[+\d][\d .:/_-]*\W*$",
    "url": r"^(?i:https?|ftp)://",
    "uuid": r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\W*$",
}
#: Neighbours that end with a sign of assignment to a secret word.
_NEAR_SIGN = SECRET_WORDS.removesuffix("(?:$|[^a-z])") + r"\s?(?:[:=]+|[-=]+>)$"
_GAP = r"[\x00-\x20\"'<>,;()\[\]{}`|]+"
_FEATURES = [
    "length", "digit_share", "upper_share", "other_share", "transitions", "letter_case_changes",
    "distinct_share", "dictionary_coverage", "path_signs", "dots", "has_extension",
    "secret_word_near", "assigned", "words_near",
]


#: What stands between a secret word and its value.
_SIGN = r"(?i)^(?:[:=]+|[-=]+>?|is|was|are)$"
#: An assignment within a word.
_ASSIGNS = r"^[^=:]+[=:]+[^=:]"


def _is_candidate(word: Column) -> Column:
    """Twelve characters or more with a digit, or twenty or more with letters of changing case."""
    n = F.length(word)
    return ((n >= 12) & word.rlike("[0-9]")) | ((n >= 20) & word.rlike("[a-z][A-Z].*[A-Z][a-z]"))


def _is_told(word: Column, before: Column, before2: Column) -> Column:
    """A value, whatever it is, that is assigned to a secret word or stands right after it."""
    names = lambda w: w.rlike(SECRET_WORDS) & ~w.rlike(_ASSIGNS)
    assigned = word.rlike(_ASSIGNS) & F.regexp_extract(word, "^([^=:]+)", 1).rlike(SECRET_WORDS)
    after = names(before) | (before.rlike(_SIGN) & names(before2))
    return assigned | (F.coalesce(after, F.lit(False)) & ~word.rlike(_SIGN) & (word != ""))


def secret_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, place, word, key, value, near)``; ``place`` counts words from 1.

    Words of a secret's length and characters, and what is assigned to a secret word or
    stands right after it, whatever its length and characters.
    ``near`` has the key of an assignment and the two words before.
    """
    rows = keyed(docs, id_col, text_col)
    # Words before the first one are null.
    at = lambda i, back: F.when(i > back, F.element_at("w", F.greatest(i - back, F.lit(1))))
    words = rows.select(*KEY, F.explode(F.array(F.split(F.coalesce("text", F.lit("")), _GAP))).alias("w"))
    found = words.select(
        *KEY,
        F.inline(
            F.transform(
                F.filter(
                    F.sequence(F.lit(1), F.size("w")),
                    lambda i: _is_candidate(F.element_at("w", i))
                    | _is_told(F.element_at("w", i), at(i, 1), at(i, 2)),
                ),
                lambda i: F.struct(
                    i.alias("place"),
                    F.element_at("w", i).alias("word"),
                    at(i, 1).alias("before"),
                    at(i, 2).alias("before2"),
                ),
            )
        ),
    )
    parts = r"^-{0,2}([A-Za-z][A-Za-z0-9_.-]{1,40})[=:](.+)$"
    key = F.regexp_extract("word", parts, 1)
    value = F.when(key != "", F.regexp_extract("word", parts, 2)).otherwise(F.col("word"))
    return found.select(
        *KEY, "place", "word", key.alias("key"),
        # A value of nothing but such signs stays as it is.
        F.regexp_replace(value, r"(?<=[^!?.:*#%&$])[!?.:*#%&$]+$", "").alias("value"),
        F.concat_ws(" ", "before2", "before", key).alias("near"),
    )


def _letter_runs(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda r: F.length(r) >= 3)


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(run)``: words that many texts have, whatever the size of the table.

    Words are counted where they are read, so a task hands on one row for each of its
    distinct words.
    """
    text = F.lower(F.col(text_col).cast("string"))
    kind = F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(text), F.lit(64)).cast("int")
    )
    # Below the explode: a text's class is found once, not once a word.
    texts = docs.filter(F.col(text_col).isNotNull()).select(
        F.array_distinct(F.split(text, r"[^\p{L}]+")).alias("words"), kind.alias("kind")
    )
    # Outer, since a filter for empty arrays would split every text again.
    words = texts.select(F.explode_outer("words").alias("run"), "kind")
    counts = words.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.bit_or("kind").alias("kinds"))
    n = docs.filter(F.col(text_col).isNotNull()).count()
    return counts.filter(
        (F.col("n") >= F.lit(MIN_SHARE * n)) & (F.bit_count("kinds") >= MIN_CLASSES)
    ).select("run")


def _coverage(candidates: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``(value, covered)``: letters of a value in runs that are words of the dictionary."""
    runs = (
        candidates.select("value").distinct()
        .select("value", F.explode(_letter_runs(F.col("value"))).alias("run"))
    )
    return (
        runs.join(dictionary(docs, text_col), "run").groupBy("value")
        .agg(F.sum(F.length("run")).alias("covered"))
    )


def secret_features(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The candidates with the numbers that the forest looks at.

    Null and empty texts have no candidates, nor has an empty table.  A text is taken
    whole, as one row; repeated rows have their candidates each.  Other columns are not read.
    """
    found = stored(secret_candidates(docs, id_col, text_col).filter("value <> ''"), "candidates")
    covered = stored(_coverage(found, docs, text_col), "coverage")
    value, n = F.col("value"), F.length("value").cast("double")
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    return found.join(covered, "value", "left").select(
        *KEY, "place", "word", "key", "value", "near",
        n.alias("length"),
        (count("[0-9]") / n).alias("digit_share"),
        (count("[A-Z]") / n).alias("upper_share"),
        (count("[^A-Za-z0-9]") / n).alias("other_share"),
        (count("[0-9](?=[^0-9])|[A-Za-z](?=[^A-Za-z])|[^A-Za-z0-9](?=[A-Za-z0-9])") / n)
        .alias("transitions"),
        (count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n).alias("letter_case_changes"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.least(n, F.lit(64.0)))
        .alias("distinct_share"),
        (F.coalesce("covered", F.lit(0)) / n).alias("dictionary_coverage"),
        count(r"[/\\@]").alias("path_signs"),
        count(r"[.]").alias("dots"),
        value.rlike(r"\.[A-Za-z]{2,4}$").cast("double").alias("has_extension"),
        F.col("near").rlike(SECRET_WORDS).cast("double").alias("secret_word_near"),
        ((F.col("key") != "") | F.col("near").rlike(_NEAR_SIGN)).cast("double").alias("assigned"),
        F.regexp_count("near", F.lit(r"[A-Za-z]{2,}")).cast("double").alias("words_near"),
    )


def rule_labels(features: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for known formats and for keys with an assigned value of 16
    characters or more, 0 for forms that are no secrets and for words of the dictionary
    that only follow a secret word, null where neither is sure."""
    value = F.col("value")
    known = F.lit(False)
    for pattern in KNOWN_FORMATS.values():
        known |= value.rlike(pattern)
    other = F.lit(False)
    for pattern in NOT_SECRET.values():
        other |= value.rlike(pattern)
    told = (F.col("secret_word_near") == 1) & value.rlike(r"^[A-Za-z0-9+/_=-]{16,}$") & value.rlike("[0-9]")
    prose = (F.col("assigned") == 0) & (F.col("dictionary_coverage") == 1)
    return features.withColumn("label", F.when(known, 1).when(other, 0).when(told, 1).when(prose, 0))


@dataclass
class SecretFilter:
    #: None where labels of both kinds were missing.
    forest: RandomForestClassificationModel | None


def _vectors(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(features)


def fit_secret_filter(labelled: DataFrame, rows: int = TRAIN_ROWS) -> SecretFilter:
    """Learns from ``rows`` findings with ``label`` (1 secret, 0 not), equal values once."""
    known = labelled.filter("label is not null").withColumn("h", F.xxhash64("value"))
    sample = stored(
        known.groupBy("h", "label").agg(F.min_by(F.struct(*_FEATURES), "near").alias("f"))
        .orderBy("h", "label").limit(rows)
        .select("h", F.col("label").cast("double").alias("label"), "f.*"),
        "labelled-findings",
    )
    if sample.select("label").distinct().count() < 2:
        return SecretFilter(None)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features"
    )
    # One partition of a bounded sample: the forest is the same in every run.
    return SecretFilter(forest.fit(_vectors(sample.coalesce(1).sortWithinPartitions("h", "label"))))


def scan_secrets(features: DataFrame, learned: SecretFilter, threshold: float = 0.5) -> DataFrame:
    """Findings with ``score`` (the forest's share of votes for a secret) and ``is_secret``.

    Columns: doc_id, text_key, place (of the word in the text), value, near, the features,
    score, is_secret.  Without a forest the score is null and every candidate stays.
    Texts that are null or empty have no candidates; repeated rows have theirs each.
    """
    if learned.forest is None:
        return features.withColumn("score", F.lit(None).cast("double")).withColumn(
            "is_secret", F.lit(True)
        )
    votes = learned.forest.transform(_vectors(features))
    score = vector_to_array("probability").getItem(1)
    return votes.select(*features.columns, score.alias("score"), (score >= threshold).alias("is_secret"))
