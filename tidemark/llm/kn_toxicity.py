"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models, toxic and ordinary, predict each character of a word from up to four before it.
They discount their own counts from order five down to order three, by Kneser-Ney
continuation counts, and both end in one shared model of order two, whose continuation counts
come from the words of all documents. For what neither class has seen the shared part cancels,
so a score needs two tables only: the log-ratios of seen grams, and the log-ratios of the
backoff weights of seen contexts. Both stay whole. They come from the labelled rows only, whose
number has a bound: up to MODEL_ROWS entries they are sent to the tasks, which value each word
where they read it. A larger model stays in Parquet: every distinct gram, and from these every
distinct word, is valued once by joins. Toxic documents mostly
consist of ordinary words, so a document is compared with its ordinary reading word by word:
the toxic likelihood of a word mixes the ordinary one with TOXIC_SHARE of the toxic model's.
The sum of the log-ratios over the number of words is the document's value; a logistic curve
fitted on labelled rows that the counts left out turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import hash_sample, heaviest, held_out, materialise, read, single_labels, slices, texts_of, whole_row

ORDER = 5
BITS = 12  # of a five-gram's key for each character
DISCOUNT = 0.75
ALPHABET = 256
TOXIC_SHARE = 0.02  # weight of the toxic model in the likelihood of a toxic document's word
LABEL_ROWS = 200_000  # labelled rows that class counts and calibration are learned from, at most
MODEL_ROWS = 1 << 23  # entries (16 bytes) of a model that is sent to the tasks; a larger one is joined
CACHED_WORDS = 200_000  # values of words that a task keeps
TOP_WORDS = 1 << 16  # frequent words whose values are sent to the tasks; the others are joined
HELD_WORDS = 100_000  # distinct words that a task keeps at a time
WORD_SLICE_BYTES = 200_000  # words cut into grams at a time
CUTOFF = 0.5
LOWEST = -0.99  # of a mean log-ratio in units of TOXIC_SHARE, before its logarithm is taken
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 200  # characters after which a run of letters is cut into several words

COUNT, CALIBRATE = 0, 2  # added to the label of a row: what it is used for


def words_of(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all characters of all words, each key's word, and the number of keys of each word.

    A word is framed by marks 1 and 2. A key holds the character and up to four before it,
    twelve bits each; characters beyond that range are folded into it.
    """
    text = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = (text % 4093 + 2 * (text >= 4093)).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(code)) - np.repeat(starts, lengths)
    key = code.copy()
    for lag in range(1, ORDER):
        before = np.zeros_like(code)
        before[lag:] = code[:-lag]
        key |= np.where(place >= lag, before, 0) << (BITS * lag)
    inside = place > 0
    return key[inside], np.repeat(np.arange(len(words)), lengths)[inside], lengths - 1


def _count(sample):
    def rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
        columns = [pa.array(list(c), pa.int64()) for c in zip(*counts.values())]
        return pa.record_batch([pa.array(list(counts), pa.string()), *columns], names=["word", "n", "ordinary", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        role = sample.value
        counts: dict[str, list[int]] = {}
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                label = role.get(doc_id)
                for w, n in Counter(words_of(text)).items():
                    c = counts.get(w)
                    if c is None:
                        c = counts[w] = [0, 0, 0]
                    c[0] += n
                    if label == 0 or label == 1:
                        c[1 + label] += n
            if len(counts) >= HELD_WORDS:
                yield rows(counts)
                counts = {}
        if counts:
            yield rows(counts)

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by gram of words with counts."""
    for batch in slices(batches, "word", WORD_SLICE_BYTES):
        key, word, _ = keys_of(batch.column("word").to_pylist())
        unique, where = np.unique(key, return_inverse=True)
        sums = [
            pa.array(np.bincount(where, batch.column(c).to_numpy()[word], len(unique)).astype(np.int64)) for c in ("ordinary", "toxic")
        ]
        yield pa.record_batch([pa.array(unique), *sums], names=["gram", "ordinary", "toxic"])


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each character of each word."""
    for batch in slices(batches, "word", WORD_SLICE_BYTES):
        key, word, _ = keys_of(batch.column("word").to_pylist())
        yield pa.record_batch([batch.column("word").take(pa.array(word)), pa.array(key)], names=["word", "gram"])


def _low(chars: int) -> int:
    return (1 << (BITS * chars)) - 1


def levels(counted: DataFrame) -> dict[int, DataFrame]:
    """Grams of 5, 4, 3 and 2 characters with counts by class.

    Longest grams, and grams that start a word, keep their counts; others count in how many
    ways (in each class) they are preceded.
    """
    table = counted.where(F.shiftrightunsigned("gram", BITS * (ORDER - 1)) > 0)
    out = {ORDER: table}
    for k in range(ORDER - 1, 1, -1):
        starts = counted.where((F.shiftrightunsigned("gram", BITS * (k - 1)) > 0) & (F.shiftrightunsigned("gram", BITS * k) == 0))
        preceded = table.select(
            F.col("gram").bitwiseAND(F.lit(_low(k))).alias("gram"),
            *[(F.col(c) > 0).cast("long").alias(c) for c in ("ordinary", "toxic")],
        )
        table = (
            starts.select("gram", "ordinary", "toxic", F.lit(1).alias("way")).unionByName(preceded.withColumn("way", F.lit(1)))
            .groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.sum("way").alias("ways"))
        )
        out[k] = table
    return out


def ratios(spark: SparkSession, counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, value, n) of seen grams and of seen contexts, as log-ratios toxic / ordinary; see ``tagged``."""
    d = DISCOUNT
    by_level = levels(counted)
    two = by_level[2].withColumn("context", F.shiftrightunsigned("gram", BITS))
    ends = two.groupBy("context").agg(F.sum("ways").alias("all_ways"), F.count("*").alias("kinds"))
    chance = F.greatest(F.col("ways") - d, F.lit(0.0)) + d * F.col("kinds") / ALPHABET
    below = two.join(ends, "context").select("gram", *[(chance / F.col("all_ways")).alias(f"p_{c}") for c in ("toxic", "ordinary")])
    grams, contexts = [], []
    for k in range(3, ORDER + 1):
        seen = by_level[k].where("toxic + ordinary > 0").withColumn("context", F.shiftrightunsigned("gram", BITS))
        context = seen.groupBy("context").agg(
            *[F.sum(c).alias(f"n_{c}") for c in ("toxic", "ordinary")],
            *[F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}") for c in ("toxic", "ordinary")],
        )
        context = context.withColumns({
            f"w_{c}": F.when(F.col(f"n_{c}") > 0, d * F.col(f"t_{c}") / F.col(f"n_{c}")).otherwise(F.lit(1.0))
            for c in ("toxic", "ordinary")
        })

        def smoothed(c: str):
            own = F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"n_{c}")).otherwise(F.lit(0.0))
            return own + F.col(f"w_{c}") * F.col(f"p_{c}")

        lower = below.select(F.col("gram").alias("suffix"), "p_toxic", "p_ordinary")
        level = materialise(
            spark,
            seen.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_low(k - 1))))
            .join(lower, "suffix").join(context, "context")
            .select(
                "gram", "context", smoothed("toxic").alias("p_toxic"), smoothed("ordinary").alias("p_ordinary"),
                (F.col("toxic") + F.col("ordinary")).alias("n"),
            ),
            f"kn-level-{k}",
        )
        grams.append(level.select(tagged(F.col("gram"), k).alias("key"), F.log(F.col("p_toxic") / F.col("p_ordinary")).alias("value"), "n"))
        contexts.append(materialise(spark, context.select(
            tagged(F.col("context"), k).alias("key"), F.log(F.col("w_toxic") / F.col("w_ordinary")).alias("value"),
            (F.col("n_toxic") + F.col("n_ordinary")).alias("n"),
        ), f"kn-contexts-{k}"))
        below = level.select("gram", "p_toxic", "p_ordinary")
    return grams[0].union(grams[1]).union(grams[2]), contexts[0].union(contexts[1]).union(contexts[2])


def tagged(key, level: int):
    """A key that tells levels apart; works for columns and arrays."""
    return key + (level << (BITS * ORDER))


def gram_values(counted: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """(gram, value) of all grams of three and more characters: the log-ratio with its backoff."""
    out, below = [], None
    length = {k: F.shiftrightunsigned("gram", BITS * (k - 1)) > 0 for k in range(3, ORDER + 2)}
    wanted = {ORDER: counted.where(length[ORDER]).select("gram")}
    for k in range(ORDER - 1, 2, -1):
        shorter = wanted[k + 1].select(F.col("gram").bitwiseAND(F.lit(_low(k))).alias("gram"))
        wanted[k] = shorter.unionByName(counted.where(length[k] & ~length[k + 1]).select("gram")).distinct()
    for k in range(3, ORDER + 1):
        seen = grams.select("key", F.col("value").alias("own"))
        backed = contexts.select(F.col("key").alias("context"), F.col("value").alias("weight"))
        table = (
            wanted[k].withColumns({
                "key": tagged(F.col("gram"), k), "context": tagged(F.shiftrightunsigned("gram", BITS), k),
                "suffix": F.col("gram").bitwiseAND(F.lit(_low(k - 1))),
            })
            .join(seen, "key", "left").join(backed, "context", "left")
        )
        lower = F.lit(0.0)
        if below is not None:
            table = table.join(below.select(F.col("gram").alias("suffix"), F.col("value").alias("lower")), "suffix", "left")
            lower = F.coalesce("lower", F.lit(0.0))
        value = F.coalesce("own", F.coalesce("weight", F.lit(0.0)) + lower)
        below = materialise(counted.sparkSession, table.select("gram", value.alias("value")), f"kn-values-{k}")
        out.append(below)
    return out[0].union(out[1]).union(out[2])


def word_values(words: DataFrame, values: DataFrame) -> DataFrame:
    """(word, n, value) of all distinct words."""
    ratio = F.exp(F.greatest(F.least(F.sum("value"), F.lit(30.0)), F.lit(-30.0)))
    summed = (
        words.select("word").mapInArrow(_word_grams, "word string, gram bigint").join(values, "gram")
        .groupBy("word").agg(F.log1p(TOXIC_SHARE * (ratio - 1)).alias("value"))
    )
    return words.select("word", "n").join(summed, "word", "left").select("word", "n", F.coalesce("value", F.lit(0.0)).alias("value"))


class Model:
    """Sorted keys and values of seen grams and seen contexts."""

    def __init__(self, grams: pa.Table, contexts: pa.Table):
        self.grams, self.contexts = self._sorted(grams), self._sorted(contexts)

    @staticmethod
    def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, value = table.column("key").to_numpy(), table.column("value").to_numpy()
        order = np.argsort(key)
        return key[order], value[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the table has, and their values (0 for others)."""
        known, values = table
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = known[at] == keys
        return found, np.where(found, values[at], 0.0)

    def gram_values(self, grams: np.ndarray) -> np.ndarray:
        """As the function of that name: a seen gram's own value, or its context's weight and what the shorter gram has."""
        out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        for k in range(ORDER, 2, -1):
            rows = np.flatnonzero(open_ & (grams >> (BITS * (k - 1)) > 0))
            part = grams[rows] & _low(k)
            seen, own = self._find(self.grams, tagged(part, k))
            out[rows] += np.where(seen, own, self._find(self.contexts, tagged(part >> BITS, k))[1])
            open_[rows[seen]] = False
        return out

    def word_values(self, words: list[str]) -> np.ndarray:
        key, word, _ = keys_of(words)
        unique, where = np.unique(key, return_inverse=True)
        sums = np.bincount(word, self.gram_values(unique)[where], len(words))
        return np.log1p(TOXIC_SHARE * (np.exp(np.clip(sums, -30.0, 30.0)) - 1))


def _value_by_model(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in slices(batches, "text"):
            texts = [words_of(t) for t in texts_of(batch)]
            missing = list({w for words in texts for w in words if w not in known})
            for start in range(0, len(missing), CACHED_WORDS):
                part = missing[start : start + CACHED_WORDS]
                known.update(zip(part, model.value.word_values(part).tolist()))
            value = [math.fsum(map(known.__getitem__, words)) for words in texts]
            yield pa.record_batch(
                [batch.column("doc"), pa.array(value, pa.float64()), pa.array([len(w) for w in texts], pa.int64())], names=["doc", "value", "n"],
            )
            if len(known) > CACHED_WORDS:
                known = {}

    return run


def document_values_by_model(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """As ``document_values``, with a model that every task has."""
    rows = docs.select("text", whole_row(columns).alias("doc"))
    kind = docs.sparkSession.createDataFrame([], "value double, n bigint").schema
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return materialise(docs.sparkSession, rows.mapInArrow(_value_by_model(sent), StructType([rows.schema["doc"], *kind])), "toxicity-values")


def _value(top):
    rest_type = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = top.value
        for batch in slices(batches, "text"):
            value, n, rest = [], [], []
            for text in texts_of(batch):
                words = words_of(text)
                found = list(map(known.get, words))
                value.append(math.fsum(v for v in found if v is not None))
                n.append(len(words))
                others = Counter(w for w, v in zip(words, found) if v is None)
                rest.append([{"word": w, "times": k} for w, k in others.items()])
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc"), pa.array(value, pa.float64()), pa.array(n, pa.int64()), pa.array(rest, rest_type)],
                names=["row", "doc", "value", "n", "rest"],
            )

    return run


def document_values(docs: DataFrame, words: DataFrame, columns: list[str], top_words: int = TOP_WORDS) -> DataFrame:
    """(doc, value, n) of all rows, ``doc`` being a struct of ``columns``."""
    spark = docs.sparkSession
    top = heaviest(words, "n", top_words).select("word", "value").toPandas()
    top = spark.sparkContext.broadcast(dict(zip(top["word"].tolist(), top["value"].tolist())))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text", whole_row(columns).alias("doc"))
    kind = spark.createDataFrame([], "row bigint, value double, n bigint, rest array<struct<word:string,times:bigint>>").schema
    kind = StructType([kind["row"], rows.schema["doc"], kind["value"], kind["n"], kind["rest"]])
    found = materialise(spark, rows.mapInArrow(_value(top), kind), "toxicity-values")
    more = materialise(
        spark,
        found.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
        .join(words.select("word", F.col("value").alias("each")), "word")
        .groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("more")),
        "toxicity-rest",
    )
    whole = found.where(F.size("rest") == 0).select("doc", "value", "n")
    joined = found.where(F.size("rest") > 0).select("row", "doc", "value", "n").join(more, "row")
    return whole.unionByName(joined.select("doc", (F.col("value") + F.col("more")).alias("value"), "n"))


def logistic(z: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton steps."""
    if not len(y) or y.min() == y.max():
        return (0.0 if not len(y) else (3.0 if y[0] else -3.0)), 0.0
    x = np.stack([np.ones_like(z), z], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(2), x.T @ (y - p) - l2 * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def toxicity_values(docs: DataFrame, labels: DataFrame, label_rows: int, columns: list[str], top_words: int, model_rows: int = MODEL_ROWS):
    """(doc, value, n) of all rows, value being the sum of log-ratios; the fitted curve."""
    spark = docs.sparkSession
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")) if columns == ["doc_id"] else docs
    fold = F.floor(F.crc32(F.col("label_id").cast("string").cast("binary")) / 5) % 5 == 0
    rows = hash_sample(single_labels(labels, "toxic").where(~held_out("label_id")), "label_id", label_rows)
    # One row an id: what reaches the driver is bounded by label_rows, however often a document repeats.
    rows = rows.select("label_id", (F.col("label") + F.when(fold, CALIBRATE).otherwise(COUNT)).alias("role")).toPandas()
    sample = spark.sparkContext.broadcast(dict(zip(rows["label_id"].tolist(), rows["role"].tolist())))
    words = materialise(
        spark,
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .mapInArrow(_count(sample), "word string, n bigint, ordinary bigint, toxic bigint")
        .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "ordinary", "toxic")]),
        "kn-words",
    )
    counted = materialise(
        spark,
        words.select("word", "ordinary", "toxic").mapInArrow(_grams, "gram bigint, ordinary bigint, toxic bigint")
        .groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")),
        "char-grams",
    )
    grams, contexts = ratios(spark, counted)
    if grams.count() + contexts.count() <= model_rows:
        model = Model(*(t.select("key", "value").toArrow() for t in (grams, contexts)))
        valued = document_values_by_model(docs, model, columns)
    else:
        valued_words = materialise(spark, word_values(words, gram_values(counted, grams, contexts)), "kn-word-values")
        valued = document_values(docs, valued_words, columns, top_words)
    held = spark.createDataFrame(rows[rows["role"] >= CALIBRATE], "label_id bigint, role int")
    points = (
        valued.where("n > 0").select(F.col("doc.doc_id").cast("bigint").alias("doc_id"), "value", "n")
        .join(held, F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.min_by(F.struct("value", "n", "role"), F.struct("value", "n")).alias("p"))
        .select("p.*").toPandas()
    )
    z = np.log1p(np.maximum(points["value"].to_numpy(float) / points["n"].to_numpy(float) / TOXIC_SHARE, LOWEST))
    return valued, logistic(z, points["role"].to_numpy(float) - CALIBRATE)


def _score(a: float, b: float):
    mean = F.when(F.col("n") > 0, F.col("value") / F.col("n")).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p(F.greatest(mean / TOXIC_SHARE, F.lit(LOWEST))))))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, top_words: int = TOP_WORDS, model_rows: int = MODEL_ROWS
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels (doc_id, toxic).

    Null or wordless text has value 0. A null doc_id is scored, isn't held out and never trained
    on. Repeated rows come back as often as they occur; repeated labels vote, ties count as 1;
    null labels are left out. Without labels of both classes every score is the same. Other
    columns are ignored; an empty table gives an empty result.
    """
    valued, curve = toxicity_values(docs, labels, label_rows, ["doc_id"], top_words, model_rows)
    return (
        valued.select(F.col("doc.doc_id").alias("doc_id"), _score(*curve).alias("score"))
        .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
    )


def without_toxic(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, top_words: int = TOP_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below CUTOFF; see ``toxicity_scores``."""
    valued, curve = toxicity_values(docs, labels, label_rows, docs.columns, top_words)
    return valued.where(_score(*curve) < CUTOFF).select("doc.*")


def op7_kn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
