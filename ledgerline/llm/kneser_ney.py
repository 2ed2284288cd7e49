"""Language ID by interpolated Kneser-Ney character language models.

Trigram counts of every training text are gathered by Spark, per language.
Discounts, continuation counts and back-off weights are computed over all
types, as joins and sums; only then, if the finished tables exceed a stated
size, are the rarest types taken out, and the back-off weights of their
contexts are set so that each distribution still sums to one. What stays keeps
its probability.

A log-probability is a sum of weights of n-gram features: the log back-off of
the contexts (a, b) and b, the log-probability of c, and what the seen (b, c)
and (a, b, c) differ from that. The features of all languages lie in one sorted
array of hashes with the (language, weight) pairs of each beside it, so room
is used for seen types only. The language of least cross-entropy per symbol
wins. Its score is a softmax over cross-entropies whose sharpness is fitted on
labelled texts kept out of the counts; the same texts give each language, by
length of text, the cross-entropy beyond which a text is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import ROW_KEY, lowest, materialise, materialise_texts, row_key, without_keys

MODEL_TYPES = 3_000_000  # (language, trigram) types in the model, and as many bigram types
MODEL_BYTES = 400_000_000  # of the arrays that are broadcast; beyond that an error
CALIBRATION_ROWS = 2_000  # labelled texts that calibrate scores and rejection
CALIBRATION_SHARE = 16  # one in so many training texts of a language may calibrate
LENGTHS = (32, 128, 512)  # symbols at which a class of lengths ends
REJECT_QUANTILE = 0.98  # of calibration cross-entropies of a language and length
REJECT_MARGIN = 1.5  # times that quantile
LEAST_CLASS = 20  # calibration texts that a class of lengths needs
UNKNOWN_LANGUAGE = "und"
_FLUSH = 1_000_000
_SPACE = np.uint32(32)
_BITS, _LOW = 21, (1 << 21) - 1  # a code point


def letters() -> np.ndarray:
    """Whether each code point is a letter (1) or a mark (2)."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, form in ((1, r"\p{L}"), (2, r"\p{M}")):
        table[np.frombuffer("".join(regex.findall(form, every)).encode("utf-32-le"), np.uint32)] = kind
    return table


_LETTERS: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters and the marks on them, runs of everything else as
    one space, a space at both ends; nothing at all if the text has no letter."""
    if not _LETTERS:
        _LETTERS.append(letters())
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    kind = _LETTERS[0][code]
    if not (kind == 1).any():
        return np.zeros(0, np.uint32)
    is_letter = kind > 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of each run of others stays, as a space
    body = np.where(is_letter, code, _SPACE)[keep]
    return np.concatenate([[_SPACE], body, [_SPACE]] if is_letter[-1] else [[_SPACE], body]).astype(np.uint32)


def gram3(s: np.ndarray) -> np.ndarray:
    """Hash of each three symbols: their code points side by side, so exact.
    With 0, which is no symbol, in a place it names a shorter n-gram."""
    t = s.astype(np.uint64)
    return (t[:-2] << np.uint64(2 * _BITS)) | (t[1:-1] << np.uint64(_BITS)) | t[2:]


# ------------------------------------------------------------------ estimation


def trigram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text): counted per task in
    buffers of bounded size, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        amount = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]).take(pa.array(np.zeros(len(grams), np.int32))), pa.array(grams.view(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"],
                )

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                if len(s := symbols(text.as_py())) >= 3:
                    held.setdefault(langs[i], []).append(gram3(s))
                    amount += len(s)
                if amount >= _FLUSH:
                    yield from flush()
                    held, amount = {}, 0
        yield from flush()

    counted = train.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The `limit` rows of (lang, gram, n) of greatest share in their language,
    to a 64th of an octave; within the last such range a hash decides. Types are
    counted by range first (some thousand sums), so few beyond the limit move."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = F.floor(F.log2(F.col("n") / F.col("total")) * 64).cast("int")
    rows = counts.join(totals, "lang").select("lang", "gram", "n", share.alias("range"))
    above, last = 0, None
    for r in rows.groupBy("range").agg(F.count("*").alias("types")).orderBy(F.desc("range")).collect():
        if above + r.types > limit:
            last = r.range
            break
        above += r.types
    if last is not None:
        tail = lowest(rows.where(F.col("range") == last), F.xxhash64("lang", "gram"), "gram", limit - above)
        rows = rows.where(F.col("range") > last).unionByName(tail)
    return rows.drop("range")


def _discount(n: str) -> Column:
    """Kneser-Ney's n1 / (n1 + 2 n2), kept off 0 and 1 where counts are few."""
    n1, n2 = F.count_if(F.col(n) == 1), F.count_if(F.col(n) == 2)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(F.try_divide(n1, n1 + 2 * n2), F.lit(0.0))))


def features(counts: DataFrame, model_types: int = MODEL_TYPES) -> tuple[DataFrame, dict[str, float]]:
    """(lang, key, weight) of trigram counts, written, and each language's log
    probability of a symbol it hasn't seen. Key is `gram3` with zeros in the
    places that a shorter n-gram leaves open: (a, b, 0) and (0, b, 0) are
    contexts, (0, b, c) and (0, 0, c) predictions."""
    high = lambda c: F.shiftrightunsigned(c, _BITS)
    low = lambda c, places: F.col(c).bitwiseAND(F.lit((1 << (_BITS * places)) - 1))
    tri = counts.select("lang", "gram", "n", high("gram").alias("ab"), low("gram", 2).alias("bc"))
    pairs = materialise(tri.groupBy("lang", F.col("bc").alias("gram")).agg(F.count("*").alias("n")), "kn-pairs")
    pairs = pairs.select("lang", "gram", "n", high("gram").alias("b"), low("gram", 1).alias("c"))
    ones = materialise(pairs.groupBy("lang", "c").agg(F.count("*").alias("n")), "kn-ones")
    every = F.explode(F.array(high(high("gram")), high(low("gram", 2)), low("gram", 1)))
    vocabulary = tri.select(every.alias("c")).distinct().count() + 1  # one stands for all unseen symbols

    # one row a language: the three discounts, and what the lowest order spreads evenly
    figures = (
        counts.groupBy("lang").agg(_discount("n").alias("d3"))
        .join(pairs.groupBy("lang").agg(_discount("n").alias("d2")), "lang")
        .join(ones.groupBy("lang").agg(_discount("n").alias("d1"), F.sum("n").alias("total"), F.count("*").alias("kinds")), "lang")
        .withColumn("floor", F.col("d1") * F.col("kinds") / vocabulary / F.col("total"))
    )
    figures = materialise(figures, "kn-figures")
    p1 = F.greatest(F.col("n") - F.col("d1"), F.lit(0.0)) / F.col("total") + F.col("floor")
    ones = ones.join(figures, "lang").select("lang", "c", "floor", p1.alias("p1"))
    ones = materialise(ones, "kn-p1")

    def interpolated(rows: DataFrame, context: str, discount: str, lower: str) -> DataFrame:
        own = rows.groupBy("lang", context).agg(F.sum("n").alias("after"), F.count("*").alias("kinds"))
        seen = F.greatest(F.col("n") - F.col(discount), F.lit(0.0)) / F.col("after")
        p = seen + F.col(discount) * F.col("kinds") / F.col("after") * F.col(lower)
        return rows.join(figures.select("lang", discount), "lang").join(own, ["lang", context]).withColumn("p", p)

    def kept(rows: DataFrame, label: str) -> DataFrame:
        if rows.count() <= model_types:
            return rows.withColumn("kept", F.lit(True))
        found = most_frequent(rows.select("lang", "gram", "n"), model_types).select("lang", "gram", F.lit(True).alias("kept"))
        return materialise(rows.join(found, ["lang", "gram"], "left").na.fill({"kept": False}), label)

    def backoff(rows: DataFrame, context: str, lower: str) -> DataFrame:
        """What a context leaves to the lower order, over what that has left."""
        left = (1 - F.sum("p")) / (1 - F.sum(lower))
        return rows.where("kept").groupBy("lang", context).agg(F.greatest(left, F.lit(1e-12)).alias("back"))

    two = interpolated(pairs.join(ones.select("lang", "c", "p1"), ["lang", "c"]), "b", "d2", "p1")
    two = kept(materialise(two.select("lang", "gram", "n", "b", "p1", "p"), "kn-p2"), "kn-p2-kept")
    back2 = materialise(backoff(two, "b", "p1"), "kn-back2")
    # in the model, a pair that was taken out has its context's back-off instead
    model2 = two.join(back2, ["lang", "b"], "left").select(
        "lang", F.col("gram").alias("bc"), F.col("p").alias("full2"),
        F.when(F.col("kept"), F.col("p")).otherwise(F.coalesce("back", F.lit(1.0)) * F.col("p1")).alias("p2"),
    )
    three = interpolated(tri.join(model2, ["lang", "bc"]), "ab", "d3", "full2")
    three = kept(materialise(three.select("lang", "gram", "n", "ab", "p2", "p"), "kn-p3"), "kn-p3-kept")
    back3 = materialise(backoff(three, "ab", "p2"), "kn-back3")

    def weights(rows: DataFrame, key: Column, weight: Column) -> DataFrame:
        return rows.select("lang", key.alias("key"), weight.cast("float").alias("weight"))

    found = (
        weights(three.where("kept").join(back3, ["lang", "ab"]), F.col("gram"), F.log(F.col("p") / F.col("back") / F.col("p2")))
        .unionByName(weights(back3, F.shiftleft("ab", _BITS), F.log("back")))
        .unionByName(weights(two.where("kept").join(back2, ["lang", "b"]), F.col("gram"), F.log(F.col("p") / F.col("back") / F.col("p1"))))
        .unionByName(weights(back2, F.shiftleft("b", _BITS), F.log("back")))
        .unionByName(weights(ones, F.col("c"), F.log(F.col("p1") / F.col("floor"))))
    )
    floors = {r.lang: float(np.log(r.floor)) for r in figures.select("lang", "floor").collect()}
    return materialise(found, "kn-features"), floors


@dataclass
class Model:
    """The features of all languages: keys, and for each the run of (language,
    weight) pairs from start[i] to start[i + 1]."""

    langs: list[str]
    floor: np.ndarray
    keys: np.ndarray  # sorted
    start: np.ndarray
    lang: np.ndarray
    weight: np.ndarray
    sharpness: float = 1.0
    limits: np.ndarray | None = None  # a row per language, a column per class of lengths

    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.start, self.lang, self.weight))

    def cross_entropy(self, text: str) -> tuple[np.ndarray | None, int]:
        """Nats per symbol under each language (None without letters), and how
        many symbols were predicted."""
        s = symbols(text)
        n = len(s) - 2
        if n < 1:
            return None, 0
        total, step = n * self.floor, 1 << 18
        for begin in range(0, n, step):  # bounded memory for very long texts
            total = total + self.log_weights(gram3(s[begin : begin + step + 2]))
        return -total / n, n

    def log_weights(self, grams: np.ndarray) -> np.ndarray:
        """Sum of the weights of all features that the trigrams have."""
        kinds, times = np.unique(grams, return_counts=True)
        ab, bc = kinds >> np.uint64(_BITS), kinds & np.uint64((1 << 2 * _BITS) - 1)
        b, c = bc >> np.uint64(_BITS), bc & np.uint64(_LOW)
        wanted = np.concatenate([kinds, ab << np.uint64(_BITS), bc, b << np.uint64(_BITS), c])
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        at, times = at[hit], np.tile(times, 5)[hit]
        first = self.start[at]
        runs = self.start[at + 1] - first
        ends = np.cumsum(runs)
        spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + runs, runs)
        return np.bincount(self.lang[spots], np.repeat(times, runs) * self.weight[spots], len(self.langs))


def gathered(found: DataFrame, floors: dict[str, float], model_bytes: int = MODEL_BYTES) -> Model:
    """The model of written features; their size is counted before they move."""
    rows = found.count()
    if 22 * rows > model_bytes:
        raise ValueError(f"{rows} features need more than {model_bytes} bytes; is lang a column of languages?")
    langs = sorted(floors)
    names = found.sparkSession.createDataFrame([(i, lang) for i, lang in enumerate(langs)], "at int, lang string")
    table = found.join(F.broadcast(names), "lang").select("key", "at", "weight").toArrow()
    key, at, weight = (table[c].to_numpy() for c in ("key", "at", "weight"))
    key = key.view(np.uint64)
    order = np.lexsort((at, key))
    keys, start = np.unique(key[order], return_index=True)
    kind = np.uint16 if len(langs) < 1 << 16 else np.int32
    return Model(
        langs, np.array([floors[x] for x in langs]), keys, np.append(start, len(key)).astype(np.int64), at[order].astype(kind),
        weight[order].astype(np.float32),
    )


# ----------------------------------------------------------------- calibration


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def length_class(n: np.ndarray | int) -> np.ndarray:
    return np.searchsorted(LENGTHS, n)


def calibrate(model: Model, known: pd.DataFrame) -> None:
    """Sharpness (least log loss on a grid) and rejection limits from labelled
    texts: columns lang, ce (an array per row) and n (symbols).

    A limit is a margin over a high quantile, so a few wrong labels don't move
    it. Classes of lengths with few texts take the quantile of all of the
    language (of all languages, if it has few), widened by the spread that so
    short texts show anywhere; a shorter class never has the lower limit."""
    shape = len(model.langs), len(LENGTHS) + 1
    if len(known) == 0:
        model.sharpness, model.limits = 10.0, np.full(shape, np.inf)
        return
    ce = np.stack(known["ce"].to_list())
    true = known["lang"].map({lang: i for i, lang in enumerate(model.langs)}).to_numpy()

    def loss(beta: float) -> float:
        z = -beta * (ce - ce.min(1, keepdims=True))
        return float(-(z[np.arange(len(z)), true] - np.log(np.exp(z).sum(1))).mean())

    model.sharpness = min((2.0**i for i in range(-1, 7)), key=loss)
    own, length = ce[np.arange(len(ce)), true], length_class(known["n"].to_numpy())

    def high(x: np.ndarray) -> float:
        return float(np.quantile(x, REJECT_QUANTILE, method="higher"))

    everywhere = high(own)
    wider = np.ones(shape[1])  # of texts so short, over texts of any length
    for c in range(shape[1]):
        wider[c] = high(own[length <= c]) / everywhere if (length <= c).sum() >= LEAST_CLASS else max(1.0, 2.0 - 0.25 * c)
    limits = np.empty(shape)
    for k in range(shape[0]):
        mine = true == k
        usual = high(own[mine]) if mine.sum() >= LEAST_CLASS else everywhere
        for c in range(shape[1]):
            here = mine & (length == c)
            limits[k, c] = high(own[here]) if here.sum() >= LEAST_CLASS else usual * max(1.0, wider[c])
    model.limits = REJECT_MARGIN * np.maximum.accumulate(limits[:, ::-1], axis=1)[:, ::-1]


def _apart(known: DataFrame, calibration_rows: int) -> tuple[Column, DataFrame]:
    """Whether a row calibrates, and the rows with the bound of their language:
    an even share for each, by a hash of the whole row."""
    # written, so its size is known and the texts aren't moved to meet a few rows
    sizes = materialise(known.groupBy("lang").agg(F.count("*").alias("rows")), "languages-trained")
    langs = sizes.count()
    share = F.least(F.lit(1 / CALIBRATION_SHARE), F.lit(max(1.0, calibration_rows / max(1, langs))) / F.col("rows"))
    rows = known.join(sizes.select("lang", (share * 2.0**32).alias("bound")), "lang")
    return F.pmod(F.xxhash64(F.lit("calibration"), "doc_id", "text"), F.lit(2**32)) < F.col("bound"), rows


def train(
    docs: DataFrame,
    model_types: int = MODEL_TYPES,
    calibration_rows: int = CALIBRATION_ROWS,
    model_bytes: int = MODEL_BYTES,
) -> Model | None:
    """A model from the rows that aren't held out and have a lang and a text;
    None if there are none. Counts cover all of them but the few that calibrate;
    only the features and the calibration rows' figures come to the driver."""
    known = docs.where(~held_out(F.col("doc_id")).eqNullSafe(True) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    apart, rows = _apart(known, calibration_rows)
    counts = materialise_texts(trigram_counts(rows.where(~apart)), "trigrams")
    if counts.isEmpty():
        return None
    model = gathered(*features(counts, model_types), model_bytes)
    # an even hash leaves about calibration_rows; a row repeated very often could leave more
    chosen = rows.where(apart).select("lang", "text").limit(4 * calibration_rows)
    ce = materialise_texts(cross_entropies(chosen.select(F.lit(0).alias("doc_id"), "lang", "text"), model), "calibration")
    ce = ce.where("ce is not null")
    found = ce.select("lang", "ce", "n").toPandas()
    calibrate(model, found[found["lang"].isin(model.langs)])
    return model


# --------------------------------------------------------------------- scoring


def cross_entropies(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, ce, n) of (doc_id, lang, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.cross_entropy(t.as_py() or "") for t in batch.column(2)]
            lists = pa.array([None if c is None else c.tolist() for c, _ in found], pa.list_(pa.float64()))
            sizes = pa.array([n for _, n in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, sizes], ["doc_id", "lang", "ce", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(
        run, "doc_id long, lang string, ce array<double>, n long"
    )


def judged(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, score and whether the text is rejected. Of equally likely
    languages the first in code-point order is taken."""
    ce, n = model.cross_entropy(text or "")
    if ce is None:
        return UNKNOWN_LANGUAGE, 0.0, True
    best = int(ce.argmin())
    score = 1 / float(np.exp(-model.sharpness * (ce - ce[best])).sum())
    return model.langs[best], score, bool(ce[best] > model.limits[best, length_class(n)])


def identify(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row.

    Null texts and texts without a letter are `und` with score 0 and rejected,
    as is everything where nothing could be learned. Of equally likely
    languages the first in code-point order is taken. Repeated rows are judged
    alike; a null doc_id isn't held out; an empty table gives an empty result;
    only text takes part in a prediction."""
    model = model or train(docs, **options)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), out)
    return judged_rows(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def judged_rows(rows: DataFrame, model: Model | None) -> DataFrame:
    """(text first, then others) -> the others and lang_pred, score, rejected, written."""
    kept = rows.columns[1:]
    if model is None:
        return rows.select(*kept, F.lit(UNKNOWN_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [judged(m, t.as_py()) for t in batch.column(0)]
            langs, scores, gone = ([f[i] for f in found] for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())],
                [*kept, "lang_pred", "score", "rejected"],
            )

    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    return materialise_texts(rows.mapInArrow(run, StructType([*rows.schema.fields[1:], *new])), "languages")


def keep_identified(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """The documents whose language is known, columns as in `docs` whatever
    they are called. Rows are told apart by doc_id and text, and judged by
    their text alone, so repeated or null ids lose no other row and repeated
    rows all stay. Rows that the models reject go, null texts and texts without
    a letter among them; all rows go where nothing could be learned. An empty
    table stays empty."""
    model = model or train(docs, **options)
    if model is None:
        return docs.limit(0)
    found = judged_rows(docs.select("text", *row_key(docs)), model)
    return without_keys(docs, found.where("rejected").select(*ROW_KEY))


def model_of(counts: dict[tuple[str, str], int], spark: SparkSession, **options) -> Model:
    """A model of (lang, three symbols) -> count, for tests."""
    rows = [(lang, int(gram3(np.array([*map(ord, g)], np.uint32))[0]), n) for (lang, g), n in counts.items()]
    return gathered(*features(materialise(spark.createDataFrame(rows, "lang string, gram long, n long"), "counts"), **options))


def crc_remainder(doc_id: int) -> int:
    """The held-out rule in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4
