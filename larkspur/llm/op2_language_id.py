"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte n-grams of the lower-cased text (one to three bytes), as square roots scaled to length one.  A linear
support vector machine is trained for each pair of families, and for each pair of languages within a family; at either level
the class that wins most pairs is taken, ties going to the larger sum of margins.

Training sees about ``SAMPLE`` distinct labelled rows of each language, chosen by a hash of their id and text (fewer if there
are fewer); all languages are learned.  Each machine is trained in a task of its own on such rows alone; a row goes to at most ``COPIES``
machines of a level, so that with very many classes each machine sees fewer rows of a class and the shuffle stays linear in the
languages.  Prediction is one pass over the whole texts without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without labelled rows so is every text;
with one language only, that is predicted with score 1; repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

#: Labelled rows of a language that training sees, about; machines of a level that a row is sent to, at most.
SAMPLE, COPIES = 1000, 64
#: Classes of n-gram hashes, and the longest n-gram in bytes.
CLASSES, LONGEST = 2048, 3
#: Texts whose features are held at a time.
HELD = 256
#: Penalty of the machines, and passes over their rows.
PENALTY, PASSES = 4.0, 15
UNDETERMINED = "und"

#: Languages by family (ISO 639-1 codes); a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "hellenic": "el",
    "turkic": "tr az kk uz tk ky tt",
    "semitic": "ar he mt am",
    "iranian": "fa ku ps tg",
    "indic": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
    "malayic": "id ms jv su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


def by_family(langs: list[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for lang in sorted(langs):
        found.setdefault(family_of(lang), []).append(lang)
    return found


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of CLASSES + 1 numbers a text (the last one is constant)."""
    n = len(at) - 1
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    wide = common.LOWER[data].astype(np.uint32)
    total = np.zeros(n * CLASSES)
    code = np.zeros(len(wide), np.uint32)
    for k in range(1, LONGEST + 1):
        m = len(wide) - k + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | wide[k - 1 :]
        whole = text[:m] == text[k - 1 :]
        hashed = ((code + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(CLASSES)))
        total += np.bincount((text[:m] * CLASSES + hashed)[whole], minlength=n * CLASSES)
    out = np.sqrt(total.reshape(n, CLASSES))
    out /= np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)
    return np.concatenate([out, np.ones((n, 1))], 1).astype(np.float32)


def _featured(part: pa.RecordBatch, column: int):
    """Features of a batch's texts, HELD texts at a time, with the first row of each lot."""
    for a in range(0, part.num_rows, HELD):
        yield a, features(*common.text_bytes(part.column(column).slice(a, HELD)))


def train_machine(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, passes: int = PASSES, seed: int = 1) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss) by dual coordinate descent; y is -1 or 1."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = 0.5 / penalty
    norm = (x.astype(np.float64) ** 2).sum(1) + diagonal
    for _ in range(passes):
        largest = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - slope / norm[i], 0.0)
            if new != alpha[i]:
                largest = max(largest, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


class Classifier:
    """The trained machines: {level: {(a, b): weights}}, where a positive margin means a; levels: '' or a family."""

    def __init__(self, langs: list[str], machines: dict[str, dict[tuple[str, str], np.ndarray]]):
        self.families = by_family(langs)
        self.levels = {"": sorted(self.families), **{f: own for f, own in self.families.items() if len(own) > 1}}
        self.pairs = {k: list(combinations(classes, 2)) for k, classes in self.levels.items()}
        self.weights = {k: np.stack([machines[k][p] for p in pairs], 1).astype(np.float32) for k, pairs in self.pairs.items() if pairs}

    def _pick(self, level: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner among the level's classes, and how sure its pairs are."""
        classes, pairs = self.levels[level], self.pairs[level]
        if not pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = np.clip((x @ self.weights[level]).astype(np.float64), -30, 30)
        votes, sums, sure = (np.zeros((len(x), len(classes))) for _ in range(3))
        for k, (a, b) in enumerate(pairs):
            for c, m in ((classes.index(a), margin[:, k]), (classes.index(b), -margin[:, k])):
                votes[:, c] += m > 0
                sums[:, c] += m
                sure[:, c] += 1 / (1 + np.exp(-2 * m))
        best = np.argmax(votes + 1e-6 * np.tanh(sums / 100), 1)
        return best, sure[np.arange(len(x)), best] / (len(classes) - 1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        best, score = self._pick("", x)
        out = [UNDETERMINED] * len(x)
        for f, family in enumerate(self.levels[""]):
            rows = np.flatnonzero(best == f)
            own = self.families[family]
            if len(own) > 1 and len(rows):
                which, sure = self._pick(family, x[rows])
                score[rows] *= sure
            else:
                which = np.zeros(len(rows), int)
            for r, w in zip(rows, which):
                out[r] = own[w]
        return out, score


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, copies: int = COPIES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Classifier | None:
    """Train on rows where ``learn`` holds and the language is known; None if there are none."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # one row a language; the count is of distinct rows, so that copies don't use up the sample
    counted = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("count")).collect()
    if not counted:
        return None
    langs = sorted(r.lang for r in counted)
    families = by_family(langs)
    models: dict[str, list[tuple[str, str, str, int]]] = {g: [] for g in langs}
    for a, b in combinations(sorted(families), 2):
        for side, family in ((1, a), (-1, b)):
            for g in families[family]:
                models[g].append(("", a, b, side))
    for family, own in families.items():
        for a, b in combinations(own, 2):
            for side, g in ((1, a), (-1, b)):
                models[g].append((family, a, b, side))
    if len(langs) == 1:
        return Classifier(langs, {})
    picked = F.create_map(*(x for r in counted for x in (F.lit(r.lang), F.lit(common.share_of(sample, r["count"])))))[F.col("lang")]
    picked = rows.where(common.sampled(F.xxhash64("doc_id", "text"), picked)).withColumn("h", F.xxhash64("text", "doc_id")).dropDuplicates(["doc_id", "h"]).drop("h")

    def chosen(own: list[tuple[str, str, str, int]], x: np.ndarray) -> list[tuple[str, str, str, int]]:
        """The machines that a row goes to: of each level all, or as many as copies allow, at random by the row itself."""
        if len(own) <= copies:
            return own
        out = []
        for level in dict.fromkeys(m[0] for m in own):
            these = [m for m in own if m[0] == level]
            some = np.random.default_rng(zlib.crc32(x.tobytes())).choice(len(these), min(copies, len(these)), replace=False)
            out += [these[k] for k in sorted(some)]
        return out

    def spread(batches):
        for part in common.slices(batches):
            own = part.column(2).to_pylist()
            for a, x in _featured(part, 1):
                out = [(i, *m) for i in range(len(x)) for m in chosen(models[own[a + i]], x[i])]
                if out:
                    columns = [pa.array([o[k] for o in out]) for k in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([o[4] for o in out], pa.int32()), pa.array([x[o[0]].astype(np.float16).tobytes() for o in out])], ["level", "a", "b", "side", "x"])

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float16) for v in frame["x"]]).astype(np.float32)
        order = np.lexsort([x[:, 7], x[:, 3], x.sum(1), frame["side"]])
        w = train_machine(x[order], frame["side"].to_numpy()[order].astype(np.float64))
        return pd.DataFrame({"level": [frame["level"].iloc[0]], "a": [frame["a"].iloc[0]], "b": [frame["b"].iloc[0]], "w": [w.tolist()]})

    spreaded = picked.mapInArrow(spread, "level string, a string, b string, side int, x binary")
    machines: dict[str, dict[tuple[str, str], np.ndarray]] = {}
    for r in spreaded.groupBy("level", "a", "b").applyInPandas(train, "level string, a string, b string, w array<double>").collect():
        machines.setdefault(r.level, {})[(r.a, r.b)] = np.array(r.w)
    missing = np.zeros(CLASSES + 1)
    for level, pairs in {"": list(combinations(sorted(families), 2)), **{f: list(combinations(o, 2)) for f, o in families.items()}}.items():
        for p in pairs:  # texts of a pair may all be missing from a small sample
            machines.setdefault(level, {}).setdefault(p, missing)
    return Classifier(langs, machines)


def predict_languages(docs: DataFrame, classifier: Classifier | None, extra: tuple[Column, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_hash, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        model = shared.value
        for part in common.slices(batches):
            langs, scores = [], []
            for _, x in _featured(part, 2) if model is not None else ():
                found, score = model.predict(x)
                langs += found
                scores.append(score)
            score = np.concatenate(scores) if scores else np.zeros(part.num_rows)
            langs = langs or [UNDETERMINED] * part.num_rows
            lettered = np.array([bool(t and _LETTER.search(t)) for t in part.column(2).to_pylist()])
            langs = [g if ok else UNDETERMINED for g, ok in zip(langs, lettered)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "row_hash", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_hash long, lang_pred string, score double")


def keep_identified(docs: DataFrame, classifier: Classifier | None, least_score: float = 0.0, text: str = "text", lang: str | None = None, sure: float | None = None) -> DataFrame:
    """docs with all its columns, without rows whose language is undetermined or whose score is below least_score.

    With lang, that column gets the predicted language where it is null, and with sure also where the score is that or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    # the other columns ride along under names of our own
    rest = [c for c in docs.columns if c not in (text, lang)]
    own = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)))
    rows = docs.select(own.alias("row"), F.col(f"`{text}`").alias("text"), (F.col(f"`{lang}`") if lang else F.lit(None).cast("string")).alias("lang"))

    def run(batches):
        model = shared.value
        for part in common.slices(batches):
            found, scores = [], []
            for _, x in _featured(part, 1) if model is not None else ():
                langs, score = model.predict(x)
                found += langs
                scores.append(score)
            lettered = np.array([bool(t and _LETTER.search(t)) for t in part.column(1).to_pylist()])
            keep = lettered & (np.concatenate(scores) >= least_score) if scores else lettered
            if lang and found:
                own, predicted = part.column(2), pa.array(found, part.schema.field(2).type)
                if sure is not None:
                    own = pc.if_else(pa.array(np.concatenate(scores) >= sure), predicted, own)
                part = part.set_column(2, part.schema.field(2), pc.coalesce(own, predicted))
            yield part.filter(pa.array(keep))

    place = {c: f"row.c{k}" for k, c in enumerate(rest)} | {text: "text"} | ({lang: "lang"} if lang else {})
    return rows.mapInArrow(run, rows.schema).select(*(F.col(place[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    held_out = common.bucket(F.col("doc_id"), 5) == 0
    found = predict_languages(docs, fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
