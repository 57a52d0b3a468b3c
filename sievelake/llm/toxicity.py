"""Toxicity of whole texts by a support vector machine on a subsequence kernel.

Two strings are alike as far as they share subsequences of three letters, each
weighed by ``DECAY`` to the power of the span it takes (gap-weighted subsequence
kernel), so an insult stays near to itself with characters put in or left out.
The machine is linear in the Nyström map of some landmark strings; as the kernel
is an inner product of subsequence weights, it folds to one weight a subsequence,
and a string costs the subsequences that it holds, whatever the landmarks.

Toxic words may also share no more than their stem, each with an ending of its
own.  Therefore the beginnings of words are strings too.  Spark counts the labelled
documents that hold each; those that toxic ones hold beyond chance are stems, and a
second machine on the same kernel, over an alphabet that tells letters beyond ASCII
apart, parts them from all others.

Labels are of documents.  A toxic one says only that some string in it is toxic:
training alternates between the machine and the choice of the most toxic
string of each sentence.  A text scores as its most toxic string does.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters a-z and one for all beyond ASCII; other characters only widen gaps.
LETTERS = 27
#: Longest span of a subsequence, and its weight a character.
SPAN, DECAY = 8, 0.7
#: Longer strings are cut into windows of so many characters, half of one apart.
WINDOW = 24
#: Runs of strings of so many characters are also read as one string.
FRAGMENT = 2
#: Lengths of the beginnings of words that are strings of their own.
STARTS = range(3, 9)
#: A stem is held by toxic documents with a chance of exp(-SURPRISE) at most, were it
#: of either class alike, and weighs this many times more in toxic documents.
SURPRISE, EXCESS = 20.0, 6.0
#: Bytes of text scored at a time.
BLOCK = 1 << 22


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample, which does not grow with the input."""

    documents: int = 4000
    sentences: int = 24_000
    sentence_chars: int = 1000
    beginnings: int = 60_000
    landmarks: int = 96
    rounds: int = 4
    cost: float = 100.0
    sure: float = 0.5


@dataclass(frozen=True)
class Model:
    """``weights`` of subsequences, the machine's ``bias``, and the calibrated line;
    ``starts`` are the weights and the bias for beginnings of words, if they count."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    starts: tuple[np.ndarray, float] | None = None

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))


# ---- strings of a text -------------------------------------------------------


def fragments(words: list[str]) -> list[str]:
    """Runs of two or more short words as one string without the blanks: ``i d i o t``."""
    out, run = [], []
    for w in [*words, None]:
        if w is not None and len(w) <= FRAGMENT:
            run.append(w)
            continue
        if len(run) > 1:
            out.append("".join(run))
        run = []
    return out


def strings_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, string) numbers, each pair at least once, and the distinct strings."""
    codes, counts, found = common.words_of(pc.ascii_lower(texts))
    words = found.to_pylist()
    owner = np.repeat(np.arange(len(counts)), counts)
    if not words:
        return owner, codes, words
    short = np.array([len(w) <= FRAGMENT for w in words])[codes]
    # a run goes on where this word and the one before are short and of one text
    joined = np.zeros(len(codes), bool)
    joined[1:] = short[1:] & short[:-1] & (owner[1:] == owner[:-1])
    begins = np.flatnonzero(~joined & np.append(joined[1:], False))
    if not len(begins):
        return owner, codes, words
    ends = np.flatnonzero(joined & ~np.append(joined[1:], False)) + 1
    place: dict[str, int] = {}
    runs = [place.setdefault("".join([words[c] for c in codes[a:b].tolist()]), len(words) + len(place)) for a, b in zip(begins.tolist(), ends.tolist())]
    return np.concatenate([owner, owner[begins]]), np.concatenate([codes, np.array(runs)]), [*words, *place]


def starts_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As ``strings_of``, of the beginnings of words, each after ``MARK``."""
    codes, counts, found = common.words_of(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    words = pc.ascii_trim(pc.utf8_lower(found), string.punctuation + string.digits)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    owners, numbers, strings = [owner[:0]], [codes[:0]], []
    for n in STARTS:
        long = length >= n
        coded = pc.utf8_slice_codeunits(words.filter(pa.array(long)), 0, n).dictionary_encode()
        place = np.zeros(len(long), np.int64)
        place[long] = coded.indices.to_numpy(zero_copy_only=False) + len(strings)
        mine = long[codes]
        owners.append(owner[mine])
        numbers.append(place[codes[mine]])
        strings += [MARK + s for s in coded.dictionary.to_pylist()]
    return np.concatenate(owners), np.concatenate(numbers), strings


# ---- the kernel --------------------------------------------------------------


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (3, t) of the subsequences of a string of n characters, and their weights."""
    found = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
    at = np.array(found, np.int64).reshape(-1, 3).T
    return at, DECAY ** (at[2] - at[0] + 1.0)


_CODE = np.full(1 << 16, LETTERS, np.int32)
_CODE[:128] = 0
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)

#: The alphabet of beginnings: a-z, thirteen for all beyond ASCII, and the mark
#: before a word.
MARK, START_LETTERS = "\ue000", 40
_START_CODE = np.where(_CODE == LETTERS, LETTERS + np.arange(1 << 16) % 13, _CODE).astype(np.int32)
_START_CODE[ord(MARK)] = START_LETTERS


def _letters(s: str, n: int) -> np.ndarray:
    points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)[:n]
    return _CODE[np.minimum(points, (1 << 16) - 1)]


def windows(s: str) -> list[str]:
    return [s] if len(s) <= WINDOW else [s[i : i + WINDOW] for i in range(0, len(s) - WINDOW // 2, WINDOW // 2)]


def features(strings: list[str], letters: int = LETTERS):
    """Blocks (numbers, ids, weights, norms): for windows of equal length the
    number of the string, its subsequences with their weights, and their length."""
    code = _CODE if letters == LETTERS else _START_CODE
    by_length: dict[int, list[tuple[int, str]]] = {}
    for number, s in enumerate(strings):
        for part in windows(s):
            by_length.setdefault(len(part), []).append((number, part))
    for n, found in by_length.items():
        at, weight = _triples(n)
        if not at.shape[1]:
            continue
        step = max(1, (1 << 19) // at.shape[1])
        for a in range(0, len(found), step):
            part = found[a : a + step]
            points = np.frombuffer("".join(s for _, s in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            codes = code[np.minimum(points, (1 << 16) - 1)]
            x, y, z = codes[:, at[0]], codes[:, at[1]], codes[:, at[2]]
            held = (x > 0) & (y > 0) & (z > 0)
            ids = np.where(held, ((x - 1) * letters + (y - 1)) * letters + (z - 1), 0)
            w = np.where(held, weight, 0.0)
            # equal subsequences of a row add up before they are squared
            order = np.argsort(ids, axis=1, kind="stable")
            first = np.ones(ids.shape, bool)
            ranked = np.take_along_axis(ids, order, 1)
            first[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
            sums = np.add.reduceat(np.take_along_axis(w, order, 1).ravel(), np.flatnonzero(first.ravel()))
            rows = np.repeat(np.arange(len(part)), first.sum(1))
            norms = np.sqrt(np.bincount(rows, sums * sums, len(part)))
            yield np.array([i for i, _ in part]), ids, w, norms


def dense(strings: list[str], letters: int = LETTERS) -> np.ndarray:
    """Unit vectors of all subsequences, for a few strings of one window each."""
    out = np.zeros((len(strings), letters**3))
    for numbers, ids, w, norms in features(strings, letters):
        np.add.at(out, (numbers[:, None], ids), w / np.maximum(norms, 1e-300)[:, None])
    return out


def kernel_values(strings: list[str], base: np.ndarray, letters: int) -> np.ndarray:
    """The kernel of strings of one window each with the unit vectors ``base``."""
    used = np.flatnonzero(base.any(0))
    place = np.full(letters**3, len(used))  # what no vector of the base has goes into one more column
    place[used] = np.arange(len(used))
    shared, out = base[:, used].T, np.zeros((len(strings), len(base)))
    for a in range(0, len(strings), 1024):
        part = np.zeros((min(1024, len(strings) - a), len(used) + 1))
        for numbers, ids, w, norms in features(strings[a : a + 1024], letters):
            np.add.at(part, (numbers[:, None], place[ids]), w / np.maximum(norms, 1e-300)[:, None])
        out[a : a + 1024] = part[:, :-1] @ shared
    return out


def decisions(strings: list[str], weights: np.ndarray, bias: float, letters: int = LETTERS) -> np.ndarray:
    """The machine's value of each string: that of its best window."""
    out = np.full(len(strings), -np.inf)
    for numbers, ids, w, norms in features(strings, letters):
        value = (weights[ids] * w).sum(1) / np.where(norms > 0, norms, 1.0)
        np.maximum.at(out, numbers, value)
    return np.where(np.isneginf(out), 0.0, out) + bias


def raw_scores(texts: pa.Array, weights: np.ndarray, bias: float, starts: tuple[np.ndarray, float] | None = None) -> np.ndarray:
    """The value of each whole text: that of its best string; the bias without any."""
    texts = common.as_one(texts)
    machines = [(strings_of, weights, bias, LETTERS), *([(starts_of, *starts, START_LETTERS)] if starts else [])]
    out = np.full(len(texts), -np.inf)
    for a, b in common.slices_by_bytes(texts, BLOCK):
        for read, own, line, letters in machines:
            owner, codes, strings = read(texts.slice(a, b - a))
            found = np.full(b - a, -np.inf)
            if strings:
                np.maximum.at(found, owner, decisions(strings, own, line, letters)[codes])
            out[a:b] = np.maximum(out[a:b], np.where(np.isneginf(found), line, found))
    pa.default_memory_pool().release_unused()
    return out


# ---- training ----------------------------------------------------------------


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    v, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        on = y * (z @ v) < 1
        own = z[on] * (2 * cost * weight[on])[:, None]
        new = np.linalg.solve(ridge + own.T @ z[on], own.T @ y[on])
        if np.allclose(new, v, atol=1e-6):
            break
        v = new
    return v


def _line(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability by Platt's rule: Newton steps on smoothed labels."""
    pos, neg = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, line = np.column_stack([raw, np.ones(len(raw))]), np.array([1.0, np.log((pos + 1) / (neg + 1))])
    loss = lambda a: (weight * (np.logaddexp(0, x @ a) - target * (x @ a))).sum() + 1e-3 * a[0] ** 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -40, 40)))
        slope = x.T @ (weight * (p - target)) + np.array([2e-3 * line[0], 0])
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag([2e-3, 1e-9])
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(line - size * step) > loss(line):
            size /= 2
        line = line - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(line[0]), float(line[1])


def landmarks(toxic: Counter, clean: Counter, most: int) -> list[str]:
    """Half the strings that most tell the classes apart, half spread over all."""
    ratio = sum(toxic.values()) / max(1, sum(clean.values()))
    bare = lambda s: re.sub(r"^[^a-z\u0080-\U0010ffff]+|[^a-z\u0080-\U0010ffff]+$", "", s)[:WINDOW]
    z = {s: (n - ratio * clean[s]) / (n + ratio * clean[s] + 1) ** 0.5 for s, n in toxic.items()}
    ranked = sorted(z, key=lambda s: (-z[s], s))
    spread = sorted({*toxic, *clean}, key=lambda s: (hash_of(s), s))
    out: dict[str, None] = {}
    for source, end in ((ranked, most // 2), (spread, most)):
        for s in source:
            if len(out) >= end:
                break
            if len(bare(s)) >= 3:
                out.setdefault(bare(s))
    return list(out)


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.encode())


def _map(base: np.ndarray) -> np.ndarray:
    """The Nyström map of kernel values with the unit vectors ``base``."""
    values, vectors = np.linalg.eigh(base @ base.T)
    kept = values > 1e-6 * values.max()
    return vectors[:, kept] / np.sqrt(values[kept])


def fit(sentences: list[tuple[int, str, int]], how: Training) -> tuple[np.ndarray, float]:
    """Weights of subsequences and bias from (document, sentence, label) rows.

    A string counts once a document, so that a long or repetitive one has one say.
    """
    nothing = np.zeros(LETTERS**3), -1.0
    owner, codes, strings = strings_of(common.as_one(pa.array([s for _, s, _ in sentences], pa.string())))
    whose, document = np.unique([d for d, _, _ in sentences], return_inverse=True)
    labels = np.zeros(len(whose), bool)
    labels[document] = [bool(y) for _, _, y in sentences]
    if not strings or labels.all() or not labels.any():
        return nothing
    pairs = np.unique(np.column_stack([document[owner], codes]), axis=0)
    of_toxic = labels[pairs[:, 0]]
    p = np.bincount(pairs[of_toxic, 1], minlength=len(strings)).astype(float)
    n = np.bincount(pairs[~of_toxic, 1], minlength=len(strings)).astype(float)
    marks = landmarks(Counter({strings[i]: int(p[i]) for i in np.flatnonzero(p)}), Counter({strings[i]: int(n[i]) for i in np.flatnonzero(n)}), how.landmarks)
    base = dense(marks)
    root = _map(base)
    z = kernel_values([windows(s)[0] for s in strings], base, LETTERS) @ root
    # every string of a clean document is clean; the classes weigh the same in documents
    balance = labels.sum() / (~labels).sum()
    weight, said = p, np.column_stack([owner, codes])[labels[document[owner]]]
    for turn in range(how.rounds):
        both = np.concatenate([np.flatnonzero(weight), np.flatnonzero(n)])
        y = np.concatenate([np.ones(np.count_nonzero(weight)), -np.ones(np.count_nonzero(n))])
        each = np.concatenate([weight[weight > 0], balance * n[n > 0]])
        v = _machine(z[both], y, each, how.cost / max(1, labels.sum()))
        # the most toxic string of each toxic sentence, where there is one, once a document
        value = z @ v[:-1] + v[-1]
        order = np.lexsort((said[:, 1], -value[said[:, 1]], said[:, 0]))
        best = said[order[np.unique(said[order, 0], return_index=True)[1]]]
        best = best[value[best[:, 1]] > how.sure * (turn + 1) / how.rounds]
        if not len(best):
            break
        weight = np.bincount(np.unique(np.column_stack([document[best[:, 0]], best[:, 1]]), axis=0)[:, 1], minlength=len(strings)).astype(float)
    return base.T @ (root @ v[:-1]), float(v[-1])


def start_counts(docs: DataFrame) -> DataFrame:
    """(start, p, n): how many toxic and other ``docs`` (toxic, text) hold each
    beginning of a word."""

    def run(batches):
        for batch in batches:
            owner, codes, strings = starts_of(common.as_one(batch.column(1)))
            toxic = batch.column(0).to_numpy(zero_copy_only=False) == 1
            pairs = np.unique(owner * len(strings) + codes)
            of_toxic, code = (toxic[pairs // len(strings)], pairs % len(strings)) if strings else (pairs > 0, pairs)
            p, n = (np.bincount(code[x], minlength=len(strings)) for x in (of_toxic, ~of_toxic))
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=["start", "p", "n"])

    return docs.select("toxic", "text").mapInArrow(run, "start string, p long, n long").groupBy("start").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def stems(strings: list[str], p: np.ndarray, n: np.ndarray, toxic: int, clean: int, most: int) -> list[int]:
    """Numbers of the beginnings that toxic documents hold beyond chance, none the
    beginning of another; of those that the same documents hold the longest."""
    share, held = toxic / (toxic + clean), np.maximum(p + n, 1)
    part = p / held
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = held * (np.where(part > 0, part * np.log(part / share), 0) + np.where(part < 1, (1 - part) * np.log((1 - part) / (1 - share)), 0))
    able = np.flatnonzero((surprise >= SURPRISE) & (p * clean >= EXCESS * n * toxic))
    out: list[int] = []
    for i in sorted(able.tolist(), key=lambda i: (-surprise[i], -len(strings[i]), strings[i])):
        if len(out) < most and not any(strings[j].startswith(strings[i]) or strings[i].startswith(strings[j]) for j in out):
            out.append(i)
    return out


def fit_starts(strings: list[str], p: np.ndarray, n: np.ndarray, toxic: int, clean: int, how: Training) -> tuple[np.ndarray, float] | None:
    """Weights of subsequences and bias of the machine for beginnings, which toxic
    documents and others hold ``p`` and ``n`` times; None without any stem."""
    found = stems(strings, p, n, toxic, clean, how.landmarks) if toxic and clean else []
    if not found:
        return None
    # landmarks: the stems, and for each the likest others that clean documents hold
    near = kernel_values(strings, dense([strings[i] for i in found], START_LETTERS), START_LETTERS)
    near[n == 0] = -1
    near[found] = -1
    likest = np.unique(np.argsort(-near, axis=0, kind="stable")[:2])
    base = dense([strings[i] for i in dict.fromkeys([*found, *likest.tolist()])], START_LETTERS)
    root = _map(base)
    z = kernel_values(strings, base, START_LETTERS) @ root
    others = np.flatnonzero((n > 0) & ~np.isin(np.arange(len(n)), found))
    both = np.concatenate([found, others])
    y = np.concatenate([np.ones(len(found)), -np.ones(len(others))])
    v = _machine(z[both], y, np.concatenate([p[found], toxic / clean * n[others]]), how.cost / toxic)
    return base.T @ (root @ v[:-1]), float(v[-1])


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    At most ``how.documents`` labelled documents of each class are read, chosen by
    a hash of their id, and of half of them at most ``how.sentences`` sentences; the
    other half calibrates, weighed to the classes' whole numbers.
    """
    kind = dict(docs.dtypes)["doc_id"]
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    known = known.withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("toxic") == y).orderBy("h", "doc_id").limit(how.documents)
        chosen = part if chosen is None else chosen.union(part)
    # bounded by how.documents, so it may be sent to all executors
    mine = docs.select("doc_id", "text").join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id").filter("text IS NOT NULL")
    fitting = F.col("h").bitwiseAND(F.lit(1 << 20)) == 0
    parts = mine.filter(fitting).select("toxic", "h", F.posexplode(F.split("text", r"[.!?\n]+")).alias("i", "sentence")).filter(F.length("sentence").between(1, how.sentence_chars))
    # one share of the sentences of both classes, so that their documents compare
    some = parts.orderBy(F.xxhash64("h", "i"), "sentence").limit(how.sentences)
    sample = [(r["h"], r["sentence"], r["toxic"]) for r in some.select("h", "sentence", "toxic").collect()]
    weights, bias = fit(sample, how)
    counts = {r["toxic"]: r["n"] for r in mine.filter(fitting).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # rare beginnings tell nothing; of the others those that toxic documents hold come first
    often = start_counts(mine.filter(fitting)).filter("p >= 8 OR p + n >= 20").orderBy(F.desc("p"), F.desc("n"), "start").limit(how.beginnings).collect()
    starts = fit_starts([r["start"] for r in often], *[np.array([r[c] for r in often], float) for c in ("p", "n")], counts.get(1, 0), counts.get(0, 0), how)
    held = _scored(mine.filter(~fitting).select("toxic", "text"), weights, bias, starts).collect()
    raw, y = np.array([r["raw"] for r in held]), np.array([r["toxic"] for r in held])
    if not len(raw):
        return Model(weights, bias, 1.0, float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1))), starts)
    share = {c: sizes[c] / max(1, (y == c).sum()) for c in sizes}
    each = np.array([share[c] for c in y])
    slope, shift = _line(raw, y, each * len(raw) / each.sum())
    return Model(weights, bias, slope, shift, starts)


def _scored(docs: DataFrame, weights: np.ndarray, bias: float, starts: tuple[np.ndarray, float] | None) -> DataFrame:
    """``docs`` with ``raw`` in the place of ``text``."""
    schema = docs.drop("text").schema.add("raw", "double")

    def run(batches):
        for batch in batches:
            raw = raw_scores(batch.column("text"), weights, bias, starts)
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(raw)], names=[*rest, "raw"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) in the place of ``text``.

    Every string of a text counts, however long the text.  Null, empty and blank
    texts, and those without letters, score as the machine's bias does.  Rows are
    scored each for itself, so ties, repeats and the layout change nothing; other
    columns are kept, whatever their names.
    """
    held = common.held_apart(docs, ("text",))
    found = _scored(held, model.weights, model.bias, model.starts)
    line = F.lit(-model.slope) * F.col("raw") - F.lit(model.shift)
    back = [F.col(common.REST)[c].alias(c) for c in docs.columns if c not in ("text", "score")]
    return found.select(*back, (F.lit(1.0) / (F.lit(1.0) + F.exp(line))).alias("score"))


def op12_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels outside the held-out third."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = train(docs.filter(~out), common.read(spark, sf_dir, "labels").filter(~out))
    found = score(docs, model)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
