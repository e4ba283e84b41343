"""Toxicity of restored text: Viterbi decoding of disguised words under a character language model, then a linear score.

1. The character language model counts letter trigrams of all documents (26 letters, one code for all other letters, and a boundary,
   so its size is fixed); counts are summed by trigram.
2. Every token is a lattice: a look-alike reads as a letter or as noise, an inner separator is dropped, a run of one letter is one
   or two of it. Single characters with separators between them are one lattice, in which a separator may also be a break between
   words. Viterbi finds the reading with the best sum of channel and language model scores. A token whose lattice has one path only, that of
   letters without a doubled one, is its own reading. Readings are kept while they fit.
3. At most ``MAX_TRAIN`` labelled ids (those with the smallest hashes; none that is held out), and of each the text with the smallest
   hash, give a logistic regression on the presence of ``FEATURES`` words, those that tell the classes apart best among
   those of ``MIN_DOCS`` training texts or more. A text's words are its tokens' readings, and the tokens of letters themselves.
   The number of features is the size of the model, as its bound of rows is; scores use the text only.

Defined results: null and empty texts get the score of a text without words; an id that is null counts as held out; no usable
labels, or one class only, give everyone the share of that class; repeated rows are scored alike, rows of one id with unlike texts
by their texts; an empty table gives an empty result; other columns are ignored. Whole texts are read; one Arrow batch and one text's tokens are in memory at a time.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.tables import stored

MAX_TRAIN = 10_000
FEATURES = 200
MIN_DOCS = 4
RIDGE = 1.0
#: look-alikes and the letters they may stand for
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e", "£": "l", "¡": "i", "2": "z", "6": "bg"}
NOISE = frozenset("*#%&~^.,-_'\"`:;/\\=<>)[]{}? ")
#: what the channel takes for a look-alike read as a letter, for one dropped, for noise dropped, for a letter repeated, for one doubled
COST_LOOK, COST_DROP, COST_NOISE, COST_RUN, COST_TWO = 0.7, 3.0, 0.3, 0.5, 1.0
COST_BREAK, COST_PAIR = 1.0, 3.0  # for a separator taken as a break between words; for a doubled letter read as one
_SYMBOLS = 28  # boundary, a to z, any other letter
_EDGE = re.compile(r"^[^\w@$!+|(€£¡]+|(?:[^\w@$+|(€£¡]|([@$+|(€£¡])\1+)+$")
_DOUBLE = re.compile(r"(.)\1")
_LOOK = re.escape("".join(LOOKS))
_SPACED = re.compile(rf"(?<!\S)(?:[^\W_]|[{_LOOK}])(?:[ ._*-]{{1,2}}(?:[^\W_]|[{_LOOK}])(?![^\W_])){{2,}}(?!\S)")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


# --- the character language model

def _code(c: str) -> int:
    c = c.lower()
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


@functools.cache
def _codes() -> np.ndarray:
    """The code of every character."""
    out = np.zeros(0x110000, np.int8)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = 27
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = i + 1
    return out


def _counts(batches):
    import pyarrow as pa

    total = np.zeros(_SYMBOLS**3, np.int64)
    for batch in batches:
        for x in batch.column(0):
            text = x.as_py()
            c = np.concatenate([[0, 0], _codes()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")].astype(np.int64), [0]])
            k = c[:-2] * _SYMBOLS**2 + c[1:-1] * _SYMBOLS + c[2:]
            total += np.bincount(k[(c[1:-1] > 0) | (c[2:] > 0)], minlength=_SYMBOLS**3)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["code", "n"])


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(third | first two) of letter codes, from all documents; a fixed size."""
    parts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(_counts, "code int, n long")
    counts = np.zeros(_SYMBOLS**3)
    for r in parts.groupBy("code").agg(F.sum("n").alias("n")).collect():  # a row per trigram at most
        counts[r.code] = r.n
    counts = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    two = counts.sum(axis=0, keepdims=True) + 0.5  # backed off to pairs
    pair = two / two.sum(axis=2, keepdims=True)
    return np.log((counts + 5.0 * pair) / (counts.sum(axis=2, keepdims=True) + 5.0))


# --- decoding


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """For each stretch of a token its readings and what they cost; in a spaced one a separator may be a break, read as a blank."""
    out, i = [], 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c + c, 0.0 if n == 2 else COST_RUN + COST_TWO), (c, COST_PAIR if n == 2 else COST_RUN)])
        elif c in LOOKS:
            out.append([(x * k, COST_LOOK + (k > 1) * COST_TWO + (n > 2) * COST_RUN) for x in LOOKS[c] for k in (1, 2) if k <= n] + [("", COST_DROP if n == 1 else COST_NOISE * 2)])
        else:
            out.append([("", COST_NOISE if c in NOISE else COST_DROP)] + ([(" ", COST_BREAK)] if spaced else []))
        i = j
    return out


def decode(token: str, model: list, spaced: bool = False) -> str:
    """The best reading of a lower-case token. model: nested lists of log probabilities."""
    best = {(0, 0): (0.0, "")}
    for readings in lattice(token, spaced):
        then: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, read) in best.items():
            for letters, cost in readings:
                x, y, s = a, b, score - cost
                for c in letters:
                    z = _code(c)
                    s += model[x][y][z]
                    x, y = (0, 0) if z == 0 else (y, z)  # a word begins as every token does
                if (x, y) not in then or s > then[x, y][0]:
                    then[x, y] = (s, read + letters)
        best = then
    return max((s + model[a][b][0], read) for (a, b), (s, read) in best.items())[1]


class Restored(dict):
    """Token -> restored word, kept for a while."""

    MOST = 300_000

    def __init__(self, model: np.ndarray) -> None:
        super().__init__()
        self.model = model.tolist()

    def __missing__(self, token: str) -> str:
        if len(self) >= self.MOST:
            self.clear()
        core = token if token.isalpha() else _EDGE.sub("", token)
        if not core.isalpha() or _DOUBLE.search(core):  # else there is one path
            core = decode(core, self.model) if any(c.isalpha() for c in core) and not core.isdigit() else ""
        self[token] = core
        return core


def restored_words(text: str, known: Restored) -> set[str]:
    low = text.lower()
    found = set()
    for token in set(low.split()):
        found.add(known[token])
        core = _EDGE.sub("", token)
        if core.isalpha():
            found.add(core)
    for m in _SPACED.finditer(low):
        found.update(decode(m[0], known.model, True).split())
    found.discard("")
    return found


# --- the classifier


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAIN) -> tuple[dict[str, float], float]:
    """Weights of words and the intercept, from at most ``most`` labelled rows that aren't held out."""
    own = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id")))
    sample = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)  # bounded, so it may be broadcast

    def words(batches):
        import pyarrow as pa

        known = Restored(model)
        for batch in batches:
            found = [sorted(restored_words(x.as_py(), known)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["y", "words"])

    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id").agg(F.first("y").cast("int").alias("y"), F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t")).select("y", "t")
    per = stored(texts.mapInArrow(words, "y int, words array<string>"), "words")  # a row per labelled id; read thrice
    # first the words that tell the classes apart, counted on the executors, then the rows of the sample in these words
    n = {r.y: r.n for r in per.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}, math.log((n1 + 0.5) / (n0 + 0.5))
    df = per.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= MIN_DOCS)
    share = (F.col("a") + F.col("b")) / float(n1 + n0)
    z = (F.col("a") / float(n1) - F.col("b") / float(n0)) / F.sqrt(share * (1 - share + 1e-9) * (1.0 / n1 + 1.0 / n0))
    chosen = [r.w for r in df.select("w", F.abs(z).alias("z")).orderBy(F.round("z", 9).desc(), "w").limit(FEATURES).collect()]
    rows = per.select("y", F.array_intersect("words", F.array(*map(F.lit, chosen)).cast("array<string>")).alias("words")).collect()  # a row per labelled id
    index = {w: i for i, w in enumerate(chosen)}
    x, y = np.zeros((len(rows), len(chosen) + 1), np.float32), np.array([r.y for r in rows], np.float64)
    x[:, -1] = 1
    for i, r in enumerate(sorted(rows, key=lambda r: (r.y, r.words))):
        x[i, [index[w] for w in r.words]] = 1
        y[i] = r.y
    w = np.zeros(x.shape[1])
    w[-1] = math.log(n1 / n0)
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(12):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return {c: float(v) for c, v in zip(chosen, w, strict=False)}, float(w[-1])


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = language_model(docs, text)
    weights, bias = train(docs, labels, model, doc_id, text, label, most)
    df = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches):
        import pyarrow as pa

        known = Restored(model)
        for batch in batches:
            scores = []
            for x in batch.column(2):
                s = bias + sum(weights[w] for w in sorted(restored_words(x.as_py(), known) & weights.keys()))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
