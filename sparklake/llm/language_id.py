"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed byte n-grams of words, learned from labelled texts. A document
is a mixture: every word is drawn from one of its languages, with the n-gram likelihood of that language.
Expectation-maximisation estimates the document's language proportions; the language set is chosen by penalised
likelihood (BIC): from the likeliest single language up, the language that helps most joins as long as the gain in
likelihood exceeds the penalty. The predicted language is the one with the largest proportion, its score that proportion times
the posterior probability of the set's likelihood against the best other single language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklake.llm._text import Words, pieces, small_batches

#: Hashed n-gram types of a model.
TYPES = 1 << 16
#: Labelled rows of each language that a model is fitted on, at most.
SAMPLE_ROWS = 400
SLICES = 64
#: Languages whose counts a task holds at once.
HELD_LANGS = 64
ROUNDS, FLOOR = 8, 1e-6
#: Languages that a model may know: 256 KB each on the driver and on every executor.
MAX_LANGS = 1000
_LETTER = regex.compile(r"\p{L}")


def _gram_types(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A type for each byte of each word, from that byte and its neighbours (a space at the word's ends); and where each word's begin, with the end."""
    keep = np.zeros(len(words.data) + 1, np.int8)
    keep[words.start] += 1
    keep[words.end] -= 1
    line = words.data.astype(np.uint32)
    before, after = np.roll(line, 1), np.roll(line, -1)
    before[words.start] = after[words.end - 1] = 0x20
    mixed = (before << np.uint32(16) | line << np.uint32(8) | after) * np.uint32(0x9E3779B1)
    types = (mixed >> np.uint32(16))[np.cumsum(keep[:-1], dtype=np.int8) > 0]
    return types, np.concatenate([[0], np.cumsum(words.end - words.start)])


def _count(texts: pa.Array) -> np.ndarray:
    return np.bincount(_gram_types(Words(pc.utf8_lower(texts)))[0], minlength=TYPES)


class Model:
    def __init__(self, langs: list[str], log_p: np.ndarray):
        self.langs, self.log_p = langs, log_p

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Model:
        """rows: (lang, text)."""
        langs = sorted({lang for lang, _ in rows})
        return cls.of_counts({lang: _count(pa.array([text for x, text in rows if x == lang], pa.string())) for lang in langs})

    @classmethod
    def of_counts(cls, found: dict[str, np.ndarray]) -> Model:
        """found: the counts of all types by language. Add-half smoothing."""
        langs = sorted(found)
        counts = np.full((len(langs), TYPES), 0.5)
        for i, lang in enumerate(langs):
            counts[i] += found[lang]
        return cls(langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))

    def word_scores(self, words: Words) -> np.ndarray:
        """[langs, words] log likelihoods."""
        types, edges = _gram_types(words)
        out = np.empty((len(self.langs), len(words)))
        for k, of_type in enumerate(self.log_p):
            total = np.concatenate([[0], np.cumsum(of_type[types], dtype=np.float64)])
            out[k] = total[edges[1:]] - total[edges[:-1]]
        return out


def _em(p: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [langs, docs] and log likelihoods; p: [langs, words] likelihoods, first: where each document's words begin, with the end."""
    size = np.diff(first)
    pi = np.full((len(p), len(size)), 1 / len(p))
    for _ in range(ROUNDS):
        joint = p * np.repeat(pi, size, axis=1)
        joint /= joint.sum(axis=0)
        pi = np.maximum(np.add.reduceat(joint, first[:-1], axis=1) / size, FLOOR)
        pi /= pi.sum(axis=0)
    total = (p * np.repeat(pi, size, axis=1)).sum(axis=0)
    return pi, np.add.reduceat(np.log(total), first[:-1])


def infer(scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents with at least one word each: proportions [docs, langs], the index of the largest, and its score."""
    langs, docs = len(scores), len(counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    p = np.exp(np.maximum(scores - scores.max(axis=0), -30))
    single = np.add.reduceat(np.maximum(scores - scores.max(axis=0), -30), first[:-1], axis=1)
    members = single.argmax(axis=0)[:, None]
    at = np.arange(docs)
    pi = np.zeros((docs, langs))
    pi[at, members[:, 0]] = 1
    fit = single[members[:, 0], at]
    penalty = 0.5 * np.log(counts + 1.0) + 1
    todo = at if langs > 1 else at[:0]
    while len(todo):
        # the language whose tenth share would help most joins, if its gain exceeds the penalty
        own = np.concatenate([[0], np.cumsum(counts[todo])])
        rows = np.arange(own[-1]) + np.repeat(first[todo] - own[:-1], counts[todo])
        now = p[:, rows]
        mixed = (now * np.repeat(pi[todo].T, counts[todo], axis=1)).sum(axis=0)
        gain = np.stack([np.add.reduceat(np.log(0.9 * mixed + 0.1 * q), own[:-1]) for q in now])
        gain[members[todo].T, np.arange(len(todo))] = -np.inf
        trial = np.concatenate([members[todo], gain.argmax(axis=0)[:, None]], axis=1)
        word = np.repeat(np.arange(len(todo)), counts[todo])
        new, new_fit = _em(np.stack([now[trial[word, k], np.arange(len(rows))] for k in range(trial.shape[1])]), own)
        better = new_fit - fit[todo] > penalty[todo]
        won = todo[better]
        fit[won] = new_fit[better]
        pi[won] = 0
        pi[won[:, None], trial[better]] = new.T[better]
        grown = np.zeros((docs, trial.shape[1]), members.dtype)
        grown[won] = trial[better]
        members, todo = grown, won if trial.shape[1] < langs else won[:0]
    best = pi.argmax(axis=1)
    single[best, at] = -np.inf
    sure = 1 / (1 + np.exp(np.clip(single.max(axis=0) - fit, -60, 60))) if langs > 1 else np.ones(docs)
    return pi, best, np.clip(pi[at, best] * sure, 0, 1)


def sample(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, text) of at most ``rows`` labelled texts with a letter for each language, whole: those whose hashed order comes first, so reruns agree.

    Rows that are equal in language, id and text count once. More than MAX_LANGS languages are refused; an empty table gives no rows.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    texts = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(order_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    if docs.select(lang_col).dropna().distinct().limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: is that a column of languages?")
    key = F.xxhash64(F.lit(7), "id", "h")
    ranked, order = texts.select("lang", "id", "h").distinct(), (key, "id", "h")
    # no texts; first among the rows of each slice of the hash, then among those that are left: at most SLICES * rows in a task
    for group in (["lang", F.pmod(key, F.lit(SLICES))], ["lang"]):
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("n") <= rows)
    picked = F.broadcast(ranked.select(F.col("lang").alias("_lang"), F.col("id").alias("_id"), F.col("h").alias("_h")))  # at most ``rows`` of MAX_LANGS languages
    found = texts.join(picked, (F.col("lang") == F.col("_lang")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    return found.dropDuplicates(["lang", "id", "h"]).select("lang", "text")


def count_types(texts: DataFrame) -> dict[str, np.ndarray]:
    """The counts of all types by language of (lang, text), taken on the executors: the driver gets sums, no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                some = np.flatnonzero(counts)
                yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], ["lang", "type", "n"])
            held.clear()

        for batch in batches:
            for part in pieces(batch, "text"):
                langs = part.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    if lang not in held and len(held) >= HELD_LANGS:
                        yield from send()
                    held[lang] = held.get(lang, 0) + _count(part.column("text").filter(pc.equal(langs, lang)))
        yield from send()

    sums = small_batches(texts).select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, type int, n long").groupBy("lang", "type").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for lang, at, n in zip(*(c.to_pylist() for c in sums.toArrow().columns), strict=True):
        found.setdefault(lang, np.zeros(TYPES, np.int64))[at] = n
    return found


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id_col, the ``keep`` columns, lang_pred, score (0 to 1) and mixture (language to proportion).

    Null texts and texts without a letter get `und`, score 0 and an empty mixture, as does everything if the model
    knows no language. A letter is a character of category L: numerals, marks and symbols aren't. Of languages that tie the first by name is
    predicted. Texts of any length are read whole. Rows stay as they are, repeated ones too; no other column is read, and ``keep`` may not hold the
    names of the result (ValueError). An empty table gives no rows.
    """
    if {c.lower() for c in keep} & {id_col.lower(), "lang_pred", "score", "mixture"}:
        raise ValueError("keep clashes with the columns of the result")
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col, 1 << 20):
                texts = pc.fill_null(part.column(text_col), "")
                lettered = np.array([_LETTER.search(x) is not None for x in texts.to_pylist()], bool)
                pred, score, mixture = np.full(len(texts), "und", object), np.zeros(len(texts)), [[] for _ in range(len(texts))]
                if lettered.any() and langs:
                    words = Words(pc.utf8_lower(texts.filter(pa.array(lettered))))
                    pi, best, sure = infer(model.word_scores(words), words.counts())
                    pred[lettered], score[lettered] = np.array(langs, object)[best], sure
                    for d, row in zip(np.flatnonzero(lettered), pi.tolist(), strict=True):
                        mixture[d] = [(k, v) for k, v in zip(langs, row, strict=True) if v > 0]
                rest = [part.column(c) for c in (id_col, *keep)]
                yield pa.record_batch([*rest, pa.array(pred, pa.string()), pa.array(score), pa.array(mixture, pa.map_(pa.string(), pa.float64()))], [id_col, *keep, "lang_pred", "score", "mixture"])

    wanted = small_batches(docs).select(id_col, text_col, *(c for c in keep if c != text_col))
    types = dict(wanted.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (id_col, *keep)) + ", lang_pred string, score double, mixture map<string, double>"
    return wanted.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that training leaves out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of the rows that are not held out; null ids are held out."""
    return Model.of_counts(count_types(sample(docs.where(~held_out(id_col)), lang_col, text_col, id_col)))
