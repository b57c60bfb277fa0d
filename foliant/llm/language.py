"""Language identification as mixture inference.

Letter trigrams (hashed to a fixed table) are counted per language over all training documents. A
document is a mixture: expectation-maximisation estimates its languages' proportions from the trigrams'
likelihoods, and the set of languages grows, largest share first, while the penalised likelihood does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import answered, extended, fold, materialise, table, without

BITS = 16
SMOOTHING = 0.5
ROUNDS = 12
UNDETERMINED = "und"
#: Neighbouring trigrams share two of three letters, so a log-likelihood counts for a third.
OVERLAP = 1 / 3
#: A table of more languages than this does not fit a broadcast and is refused.
MOST_LANGUAGES = 500
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of a text's letters in lower case, each word between spaces; none for a text without a letter."""
    raw = text.lower().encode().translate(_LETTERS).split()
    if not raw or (not text.isascii() and not any(map(str.isalpha, text))):
        return np.zeros(0, np.uint16)
    b = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8).astype(np.uint32)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            grams = trigrams(text.as_py() or "")
            if len(grams):
                total = seen.setdefault(lang.as_py(), np.zeros(1 << BITS, np.int64))
                np.add.at(total, grams, 1)
    for lang, total in seen.items():
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "gram", "n"])


class Mixture:
    """Languages and their trigrams' probabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.log = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * len(counts))) if languages else counts

    @staticmethod
    def _em(like: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            part = like * share
            share = (n / part.sum(1)) @ part / n.sum()
        return share

    def infer(self, text: str) -> tuple[str, float, list[tuple[str, float]]]:
        """The main language, a score from 0 to 1, and the proportions of the selected languages, largest first."""
        grams = trigrams(text)
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0, []
        kinds, n = np.unique(grams, return_counts=True)
        log = self.log[kinds]
        like = np.exp(log - log.max(1, keepdims=True))
        share = self._em(like, n, np.full(len(self.languages), 1 / len(self.languages)), ROUNDS)
        alone = n @ log
        order = np.lexsort((np.arange(len(share)), -share))
        chosen, best, value = order[:1], np.ones(1), OVERLAP * alone[order[0]]
        top = log.max(1)
        for k in range(2, len(order) + 1):
            some = order[:k]
            start = np.maximum(share[some], 1e-6)
            pi = self._em(like[:, some], n, start / start.sum(), ROUNDS)
            fit = OVERLAP * (n @ (np.log(np.maximum(like[:, some] @ pi, 1e-300)) + top)) - 0.5 * (k - 1) * np.log(len(grams))
            if fit <= value:
                break
            chosen, best, value = some, pi, fit
        if len(chosen) == 1:  # a single language: the likeliest by itself
            chosen = np.array([int(np.argmax(alone))])
        mix = sorted(zip([self.languages[i] for i in chosen], best.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        lead = self.languages.index(mix[0][0])
        sure = 1 / np.exp(np.minimum(OVERLAP * (alone - alone[lead]), 50)).sum() if len(mix) == 1 else 1.0
        return mix[0][0], float(min(1.0, max(0.0, mix[0][1] * sure))), mix


class LanguageModel:
    """A fitted model as a broadcast; its size is the number of languages times the fixed trigram table."""

    def __init__(self, spark, languages: list[str], counts: np.ndarray) -> None:
        self.shared = spark.sparkContext.broadcast((uuid.uuid4().hex, languages, counts))


def fit(docs: DataFrame, train: Column, *, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the texts and non-null languages of the documents where ``train`` holds; the counts cover all of them.

    Null and empty texts add nothing, repeated rows count each; without any text the model knows no
    language. More than MOST_LANGUAGES distinct languages are a ValueError.
    """
    rows = docs.filter(train & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("t"))
    counts = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "trigrams")
    if counts.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = counts.toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    matrix = np.zeros((1 << BITS, len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    matrix[counts.column("gram").to_numpy(), [place[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    return LanguageModel(docs.sparkSession, langs, matrix)


_mixtures: dict[str, Mixture] = {}


def _mixture(shared) -> Mixture:
    tag, languages, counts = shared.value
    if tag not in _mixtures:
        _mixtures.clear()
        _mixtures[tag] = Mixture(languages, counts)
    return _mixtures[tag]


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs plus lang_pred, score and languages (array of (lang, share), largest first), from whole texts alone; less the text if ``keep_text`` is false.

    A null text or one without a letter is ``und`` with score 0 and no languages; so is every text if the
    model learned none. Ties go to the language that sorts first. Rows are judged one by one, so repeated
    rows and null ids pass through; columns of a result's name are replaced. Empty in, empty out.
    """
    whole = without(docs, "lang_pred", "score", "languages")
    place = whole.columns.index(text_col)
    schema = extended(whole, "lang_pred string, score double, languages array<struct<lang:string,share:double>>", () if keep_text else (text_col,))
    shared = model.shared
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = _mixture(shared)
        for batch in batches:
            got = [mixture.infer(t.as_py() or "") for t in batch.column(place)]
            more = [
                pa.array([g[0] for g in got], pa.string()),
                pa.array([g[1] for g in got], pa.float64()),
                pa.array([[{"lang": a, "share": b} for a, b in g[2]] for g in got], kind),
            ]
            yield answered(batch, () if keep_text else (text_col,), schema, *more)

    return whole.mapInArrow(run, schema)


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit(docs, ~held_out)
    return identify(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")
