"""Language identification by interpolated Kneser-Ney character models.

Each language has one model of order ORDER over folded characters, kept in hash arrays sorted for binary
search: one array of grams and one of contexts per order, shared by all languages, with one column of values
per language. A text goes to the language with the lowest cross-entropy per character. A calibrated limit per
language flags texts that none of the models explains (`rejected`).

The models are fitted on a bounded sample (`max_chars` of text per language, rows with the smallest id hash
first); their size is bounded by it, whatever the corpus. Scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import map_texts, mixed, slices

ORDER = 5
BITS = 12                  # a character is one of 4,096 classes: itself below 2,048, else a class by remainder
MAX_CHARS = 2_000_000      # characters per language for fitting and calibration
MAX_ROWS = 4000            # rows per language for fitting and calibration
MIN_FIT = 20               # rows a language must have left to fit on, else it gives no row to calibration
UNKNOWN = "und"
REJECT_SHARE = 0.002       # share of calibration texts of a language that its limit flags
LETTER = regex.compile(r"\p{L}")


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all texts end to end, each text with ORDER - 1 leading marks, and n + 1 bounds."""
    folded = ["\n" * (ORDER - 1) + " ".join(t.lower().split()) for t in texts]
    flat = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in folded])]).astype(np.int64)
    return np.where(flat < 2048, flat, 2048 + flat % 2048).astype(np.int64), bounds


def grams(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the ORDER characters that end at each character of a text, and their bounds."""
    code = np.zeros(len(flat), np.int64)
    for j in range(ORDER):
        shift = ORDER - 1 - j
        code[ORDER - 1:] = (code[ORDER - 1:] << BITS) | flat[j:len(flat) - shift]
    own = np.ones(len(flat), bool)
    for j in range(ORDER - 1):
        own[bounds[:-1] + j] = False
    return code[own], bounds - (ORDER - 1) * np.arange(len(bounds))


def tail(code: np.ndarray, n: int) -> np.ndarray:
    """The last n characters of grams, marked with their length so that lengths never meet."""
    return (code & ((1 << BITS * n) - 1)) | (n << 60)


@dataclass
class LanguageModel:
    """Languages; for each order the sorted hashes of grams and contexts with a column of values per language."""
    langs: list[str]
    gram_keys: list[np.ndarray]
    gram_values: list[np.ndarray]
    context_keys: list[np.ndarray]
    context_values: list[np.ndarray]
    alphabet: int
    sharpness: float
    limits: np.ndarray

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """Natural log of P(last character | the ones before) for each gram and language."""
        p = np.full((len(code), len(self.langs)), 1 / self.alphabet)
        for n in range(1, ORDER + 1):
            for keys, values, wanted, add in ((self.context_keys[n - 1], self.context_values[n - 1], tail(code >> BITS, n - 1), False),
                                              (self.gram_keys[n - 1], self.gram_values[n - 1], tail(code, n), True)):
                hashes = mixed(wanted.astype(np.uint64))
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(code), bool)
                got = values[at] if len(keys) else np.zeros_like(p)
                if add:
                    p += np.where(hit[:, None], got, 0)
                else:
                    p *= np.where(hit[:, None], got, 1)
        return np.log(np.maximum(p, 1e-12))

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character of each text in each language; 0 where a text has no characters."""
        code, bounds = grams(*classes(texts))
        total = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(np.diff(bounds) > 0)
        if len(code):
            distinct, inverse = np.unique(code, return_inverse=True)
            logs = self.log_probabilities(distinct)
            for k in range(len(self.langs)):
                total[full, k] = -np.add.reduceat(logs[inverse, k], bounds[full])
        return total / np.maximum(np.diff(bounds), 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and the rejection flag of each text."""
        named = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
        if not self.langs or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        cross = self.entropies([t or "" for t in texts])
        best = cross.argmin(axis=1)
        low = cross.min(axis=1)
        score = 1 / np.exp(np.maximum(-self.sharpness * (cross - low[:, None]), -50)).sum(axis=1)
        return ([self.langs[b] if n else UNKNOWN for b, n in zip(best, named, strict=True)], np.where(named, score, 0.0),
                np.where(named, low, 0.0), ~named | (low > self.limits[best]))


def sample(docs: DataFrame, fold: Column, max_rows: int, max_chars: int) -> DataFrame:
    """(lang, text, held) of the rows of each language with the smallest id hash, within both limits.

    A row that does not fit the remaining room is passed over; where no row fits, the first one is taken. A fifth is
    held for calibration where at least MIN_FIT rows are left to fit on, else none.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).filter(fold).select(
        F.col("doc_id").cast("string").alias("doc_id"), "lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("order"),
        F.length("text").alias("size"))
    rank = Window.partitionBy("lang").orderBy("order", "doc_id")
    slim = known.select("doc_id", "lang", "order", "size").withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= max_rows)
    # the limit on rank is applied in each map task, so a language with most rows does not meet in one task

    def fitting(rows: pa.Table) -> pa.Table:   # at most max_rows
        rows, room, kept = rows.sort_by("n"), max_chars, []
        for i, size in enumerate(rows.column("size").to_pylist()):
            if size <= room:
                kept.append(i)
                room -= size
        return rows.take(kept or [0])
    held = F.pmod(F.crc32(F.concat(F.lit("held "), "doc_id")), F.lit(5)) == 0
    left = F.sum(F.when(held, 0).otherwise(1)).over(Window.partitionBy("lang"))
    kept = slim.select("doc_id", "lang", "size", "n").groupBy("lang").applyInArrow(fitting, "doc_id string, lang string, size int, n int").select(
        "doc_id", "lang", "size", (held & (left >= MIN_FIT)).alias("held")).distinct()
    return known.join(F.broadcast(kept), ["doc_id", "lang", "size"]).select("lang", "text", "held")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over the fitting rows: counted per Arrow slice, then summed."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    code, _ = grams(*classes([t for t, own in zip(texts, langs, strict=True) if own == lang]))
                    keys, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                                                     names=schema.names)
    return rows.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(code: np.ndarray, n: np.ndarray) -> tuple[list[dict], list[dict]]:
    """For each order: discounted share of each gram, and interpolation weight of each context."""
    shares, weights = [], []
    current, count = tail(code, ORDER), n.astype(float)
    for order in range(ORDER, 0, -1):
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.9)
        bare = current & ((1 << 60) - 1)
        context, index = np.unique(tail(bare >> BITS, order - 1), return_inverse=True)
        total = np.bincount(index, weights=count)
        shares.append((current, np.maximum(count - discount, 0) / total[index]))
        weights.append((context, discount * np.bincount(index) / total))
        if order > 1:   # lower orders count the distinct characters in front of a gram
            current, count = np.unique(tail(bare, order - 1), return_counts=True)
            count = count.astype(float)
    return shares[::-1], weights[::-1]


def build(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """Sorted hash arrays over all languages from each language's gram counts."""
    fitted = [kneser_ney(*counts[lang]) for lang in langs]
    tables = []
    for which, absent in ((0, 0.0), (1, 1.0)):
        keys, values = [], []
        for order in range(ORDER):
            own = [f[which][order] for f in fitted]
            all_keys = np.unique(np.concatenate([k for k, _ in own])) if own else np.zeros(0, np.int64)
            table = np.full((len(all_keys), len(langs)), absent, np.float32)
            for i, (k, v) in enumerate(own):
                table[np.searchsorted(all_keys, k), i] = v
            hashes = mixed(all_keys.astype(np.uint64))
            sort = np.argsort(hashes)
            keys.append(hashes[sort])
            values.append(table[sort])
        tables.append((keys, values))
    alphabet = len(tables[0][0][0]) + 1 if langs else 2
    return LanguageModel(langs, *tables[0], *tables[1], alphabet, 20.0, np.full(len(langs), np.inf))


def calibrate(model: LanguageModel, checks: list[tuple[str, np.ndarray]]) -> None:
    """Sets sharpness (best likelihood of the true languages) and the rejection limits from texts not fitted on."""
    if not checks:
        return
    cross = np.stack([c for _, c in checks])
    truth = np.array([model.langs.index(lang) for lang, _ in checks])
    gap = cross - cross.min(axis=1, keepdims=True)

    def loss(s: float) -> float:
        return float((s * gap[np.arange(len(truth)), truth] + np.log(np.exp(np.maximum(-s * gap, -50)).sum(axis=1))).mean())
    model.sharpness = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0), key=loss)
    for k in range(len(model.langs)):
        own = cross[(truth == k) & (cross.argmin(axis=1) == k), k]
        if len(own) >= 20:
            model.limits[k] = np.quantile(own, 1 - REJECT_SHARE) * 1.05


def fit(docs: DataFrame, fold: Column | None = None, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> LanguageModel:
    """Models of all languages among the rows that `fold` admits; four fifths of the sample fit, one fifth calibrates.

    All rows of a language with few of them fit, none calibrates.
    Rows without a text or a language teach nothing; an empty table gives a model that knows no language.
    """
    fold = F.lit(True) if fold is None else fold
    rows = sample(docs, fold, max_rows, max_chars)
    found = gram_counts(rows.filter("not held")).toArrow()   # bounded by max_chars per language
    langs = sorted(set(found.column("lang").to_pylist()))
    label = np.array(found.column("lang").to_pylist(), dtype=object)
    code, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    model = build(langs, {lang: (code[label == lang], n[label == lang]) for lang in langs})
    if langs:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        fields = [T.StructField("cross", T.ArrayType(T.DoubleType()))]

        def work(texts: pa.Array) -> list:
            return [pa.array(shared.value.entropies(texts.to_pylist()).tolist(), pa.list_(pa.float64()))]
        checks = map_texts(rows.filter("held"), "text", ["lang"], fields, work).collect()   # at most max_rows per language
        calibrate(model, [(r.lang, np.array(r.cross)) for r in checks if r.lang in langs])
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `lang_pred`, `score` (0 to 1), `cross_entropy` and `rejected` to every row, without a shuffle.

    Null texts and texts without a letter get `und`, score 0 and `rejected`; so does every text if the model knows
    no language. Equal texts get equal results; ties go to the first language by name. Existing columns of these
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)   # size bounded by max_chars per language

    def work(texts: pa.Array) -> list:
        lang, score, cross, rejected = shared.value.predict(texts.to_pylist())
        return [pa.array(lang, pa.string()), score, cross, pa.array(rejected)]
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields, work)
