"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel compares two words by the three-character subsequences they share within `REACH` characters, each weighted by
`DECAY` to the power of the length that it spans; so an insult with characters put in, or with gaps, stays close to
itself. A word is seen through its kernel values with some landmark words, whitened by the landmarks' own kernel matrix (Nyström), and a
linear machine with hinge loss is trained on that. As kernel values are sums over subsequences, the trained machine is one weight
for each subsequence that a landmark has, and a word costs a few look-ups.

The windows of a sentence are what the machine sees: a word, two or three successive words joined (so insults of several words and words
broken into pieces are seen whole), or letters written apart ("a b c"). Labels are given for whole texts, so training first finds the windows
and word beginnings that toxic texts have more often (multiple-instance learning): at least `ODDS` times as often, and by Chernoff's bound so clearly
that fewer than `CHANCE` of all would be there by chance, in the whole sample or in one of its clusters. Clusters are found from pairs of
characters, so a language with few texts has a support of its own. The clearer the odds, the greater the margin that such a window has to reach: a word that clean
texts have by chance now and then counts for less. Windows of other texts are the negatives, drawn at random and then once more from those that a first machine finds
worst; both kinds are also shown with a character put in.

A text is scored by its worst window, by the sum of its words' positive margins, and by its number of words: a logistic curve over these three
is fitted to the sampled texts, with an offset and a slope of the sum for each cluster, drawn towards those of all.
Windows of over `LONGEST` letters are not learned whole, and are scored through overlapping parts.

Training reads at most `MOST_TOXIC` and `MOST_OTHER` labelled texts, chosen by a hash of doc_id, none held out: a bounded sample by design.
Texts that look alike (the same `LOOK` least hashes of their sentences, blank ones left out) count once there, by the least doc_id. Scores use text alone.

Null and empty texts score like a text without an insult; so does every text if the labels have only one kind. Null labels and
null doc_ids are not learned from. Repeated rows are scored alike. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import saved
from panelwright.llm.language_id import held_out

LENGTH, REACH, DECAY = 3, 7, 0.7
MOST_TOXIC, MOST_OTHER, MOST_WORDS, LANDMARKS = 1500, 3000, 8_000, 48
STEM, CHANCE, ALPHABET, LONGEST = 4, 0.01, 1024, 24
#: Odds from which a window counts as toxic, and those at which it has to reach the whole margin.
ODDS, CLEAR_ODDS = 5, 50
THRESHOLD = 0.7
#: So many least sentence hashes must agree for two labelled texts to count as one.
LOOK = 4
#: Successive words that a window may join, letters scored at a time, and letter kinds up to which weights stand in one table.
SPAN, PIECE, MOST_LETTERS = 3, 400_000, 160
#: Kinds of texts found in the sample, for the support of words.
CLUSTERS, PROFILE = 8, 256
#: How strongly the curves of clusters are drawn to the common one.
SHARED = 1e-3


@lru_cache(maxsize=None)
def _kinds() -> np.ndarray:
    """1 for each letter, 2 for each white space, by code point."""
    return np.fromiter((1 if chr(i).isalpha() else 2 if chr(i).isspace() else 0 for i in range(0x110000)), np.uint8, 0x110000)


def pieces(texts: list[str | None]):
    """(owner, text) with texts of over `PIECE` characters cut at white space, the last words before a cut given to both sides."""
    for k, text in enumerate(texts):
        text = (text or "").lower()
        while len(text) > PIECE:
            cut = max(text.rfind(" ", PIECE // 2, PIECE), text.rfind("\n", PIECE // 2, PIECE))
            cut = cut if cut > 0 else PIECE
            yield k, text[:cut]
            back = cut - 200 + text[cut - 200 : cut].find(" ")
            text = text[back if back >= cut - 200 else cut - LONGEST :]
        yield k, text


def windows(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The letters of lower-case texts in one string and as code points, and start, end, owner and number of words of each window.

    A window is one word, two or three successive words of a sentence, or three or more characters written apart on one line.
    """
    text = "\n".join(texts) + "\n"
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[chars]
    alpha = kind == 1
    before = np.concatenate([[0], np.cumsum(alpha)])
    edge = np.flatnonzero(np.diff(np.concatenate([[1], (kind == 2).astype(np.int8), [1]])))
    first, last = edge[0::2], edge[1::2]
    line = np.cumsum(chars == 10)[first] if len(first) else first
    ends = np.isin(chars[last - 1], [ord(c) for c in ".!?"]) if len(first) else first
    fresh = np.concatenate([[0], (line[1:] != line[:-1]) | ends[:-1]]) if len(first) else first
    sentence = np.cumsum(fresh)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, side="right")
    out = []
    for m in range(1, SPAN + 1):
        n = max(0, len(first) - m + 1)
        at = np.flatnonzero(sentence[:n] == sentence[m - 1 : m - 1 + n])
        out.append((first[at], last[at + m - 1], owner[at], np.full(len(at), m)))
    single = np.concatenate([[0], last - first == 1, [0]])
    joined = np.concatenate([[0], (line[1:] == line[:-1]) & (single[1:-2] * single[2:-1] > 0), [0]]) if len(first) else np.zeros(2, int)
    turn = np.diff(joined.astype(np.int8))  # +1 where a chunk is joined to the one after it for the first time, -1 at the last one
    starts, stops = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = stops - starts >= 2
    starts, stops = starts[long], stops[long]
    out.append((first[starts], last[stops], owner[starts], np.ones(len(starts), np.int64)))
    a, b, own, words = (np.concatenate(x).astype(np.int64) for x in zip(*out))
    a, b = before[a], before[b]
    some = b - a >= LENGTH
    codes = chars[alpha].astype(np.int64)
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"), codes, a[some], b[some], own[some], words[some]


@lru_cache(maxsize=None)
def _offsets(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences within reach in a word of n letters, and their weights."""
    rest = [(0, *x) for x in combinations(range(1, REACH), LENGTH - 1)]
    at = np.array([[i + k for k in x] for x in rest for i in range(max(0, n - x[-1]))], dtype=np.int64).reshape(-1, LENGTH)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the subsequences of words of one length (a row for each word), and the weights of the columns."""
    at, weights = _offsets(len(words[0]))
    codes = np.array([[ord(c) % ALPHABET for c in w] for w in words], dtype=np.int64)
    ids = codes[:, at[:, 0]]
    for k in range(1, LENGTH):
        ids = ids * ALPHABET + codes[:, at[:, k]]
    return ids, weights


def norms(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square root of each word's kernel value with itself."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, w = np.take_along_axis(ids, order, 1), weights[order]
    group = np.concatenate([np.zeros((len(ids), 1), np.int64), np.cumsum(ids[:, 1:] != ids[:, :-1], axis=1)], axis=1) + (np.arange(len(ids)) * ids.shape[1])[:, None]
    sums = np.bincount(group.ravel(), w.ravel(), minlength=ids.size).reshape(ids.shape)
    return np.sqrt((sums**2).sum(axis=1))


def _by_length(words: list[str]):
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            yield part, *subsequences([words[k] for k in part])


def vectors(words: list[str]) -> list[dict[int, float]]:
    """Explicit kernel features of each word, of length one."""
    out: list[dict[int, float]] = [{} for _ in words]
    for rows, ids, weights in _by_length(words):
        size = norms(ids, weights)
        for row, own, norm in zip(rows.tolist(), ids.tolist(), size.tolist()):
            for u, w in zip(own, weights.tolist()):
                out[row][u] = out[row].get(u, 0.0) + w / norm
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values of words with landmarks."""
    own = vectors(landmarks)
    known = np.array(sorted({u for v in own for u in v}), dtype=np.int64)
    row = {u: i for i, u in enumerate(known.tolist())}
    table = np.zeros((len(known) + 1, len(landmarks)))
    for j, v in enumerate(own):
        for u, w in v.items():
            table[row[u], j] = w
    out = np.zeros((len(words), len(landmarks)))
    for rows, ids, weights in _by_length(words):
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        at = np.where(known[at] == ids, at, len(known))
        for c in range(ids.shape[1]):
            out[rows] += weights[c] * table[at[:, c]]
        out[rows] /= norms(ids, weights)[:, None]
    return out


class WordMachine:
    """The trained machine: known (sorted subsequence ids), weight of each, bias, the logistic curve of texts (see `_terms`), and the function that finds a text's cluster."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, bias: float):
        self.known, self.weight, self.bias = known, np.append(weight, 0.0), bias
        self.curve, self.nearest = np.zeros(4 + 2 * CLUSTERS), None
        self.index, self.table = None, None

    def margins(self, words: list[str]) -> np.ndarray:
        """Signed distance of each word (letters only); words under three letters have no subsequence."""
        out = np.full(len(words), self.bias)
        fit = [i for i, w in enumerate(words) if len(w) >= LENGTH]
        for rows, ids, weights in _by_length([words[i] for i in fit]) if fit else ():
            at = np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)
            at = np.where(self.known[at] == ids, at, len(self.known))
            total = self.weight[at] @ weights
            some = np.flatnonzero(total > 0)  # the rest cannot be over the bias
            if len(some):
                out[np.array(fit)[rows[some]]] += total[some] / norms(ids[some], weights)
        return out

    def weights_of(self, codes: np.ndarray):
        """A function of three positions in codes that gives the weights of these subsequences."""
        letters = np.unique(np.concatenate([self.known // ALPHABET**2, self.known // ALPHABET % ALPHABET, self.known % ALPHABET]))
        n, codes = len(letters) + 1, codes % ALPHABET
        if n > MOST_LETTERS:

            def look(x, y, z):
                ids = (codes[x] * ALPHABET + codes[y]) * ALPHABET + codes[z]
                at = np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)
                return self.weight[np.where(self.known[at] == ids, at, len(self.known))]

            return look
        if self.table is None:
            self.index = np.zeros(ALPHABET, np.int32)
            self.index[letters] = np.arange(1, n)
            self.table = np.zeros(n**3)
            self.table[(self.index[self.known // ALPHABET**2] * n + self.index[self.known // ALPHABET % ALPHABET]) * n + self.index[self.known % ALPHABET]] = self.weight[:-1]
        own = self.index[codes]
        return lambda x, y, z: self.table[(own[x] * n + own[y]) * n + own[z]]

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each lower-case text the highest margin of a window (the bias if none has more), the sum of positive margins of single words, and the number of words.

        The weights of all subsequences are summed up once along the letters, so a window costs a few differences of sums; the exact
        norm is taken only where the least norm of a word of that length leaves a chance to be the worst.
        """
        out, sums_of = np.zeros(len(texts)), np.zeros(len(texts))
        _, codes, a, b, owner, size = windows(texts)
        words = np.bincount(owner[size == 1], minlength=len(texts)).astype(float)
        if not len(a):
            return out + self.bias, sums_of, words
        many = np.maximum(1, -(-(b - a - LONGEST // 2) // (LONGEST // 2)))  # long ones are seen through overlapping windows
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        a, b, owner, size = np.repeat(a, many) + step * (LONGEST // 2), np.repeat(b, many), np.repeat(owner, many), np.repeat(size, many)
        b = np.minimum(b, a + LONGEST)
        look, total = self.weights_of(codes), np.zeros(len(a))
        for reach in range(LENGTH - 1, REACH):
            n = max(0, len(codes) - reach)
            sums = np.zeros(len(codes) + 1)
            for j in range(1, reach):
                sums[1 : n + 1] += look(slice(0, n), slice(j, j + n), slice(reach, reach + n))
            np.cumsum(sums, out=sums)
            total += DECAY ** (reach + 1.0) * (sums[np.maximum(a, b - reach)] - sums[a])
        some = np.flatnonzero(total > 1e-9)  # the rest cannot be over the bias
        a, n, owner, total, size = a[some], (b - a)[some], owner[some], total[some], size[some]
        most = total / np.array([0.0] * LENGTH + [np.sqrt((_offsets(k)[1] ** 2).sum()) for k in range(LENGTH, LONGEST + 1)])[n] if len(some) else total
        order = np.lexsort((-most, owner))
        lead = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        np.maximum.at(out, owner[lead], total[lead] / self.sizes(codes, a[lead], n[lead]))
        rest = np.flatnonzero(most > out[owner] + 1e-12)
        np.maximum.at(out, owner[rest], total[rest] / self.sizes(codes, a[rest], n[rest]))
        toxic = np.flatnonzero((size == 1) & (most > -self.bias))
        np.add.at(sums_of, owner[toxic], np.maximum(0, total[toxic] / self.sizes(codes, a[toxic], n[toxic]) + self.bias))
        return out + self.bias, sums_of, words

    def worst(self, texts: list[str]) -> np.ndarray:
        return self.evidence(texts)[0]

    @staticmethod
    def sizes(codes: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.ones(len(a))
        for k in np.unique(n).tolist():
            at, weights = _offsets(k)
            rows = np.flatnonzero(n == k)
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                x = codes[a[part][:, None] + np.arange(k)] % ALPHABET
                out[part] = norms((x[:, at[:, 0]] * ALPHABET + x[:, at[:, 1]]) * ALPHABET + x[:, at[:, 2]], weights)
        return out


def _terms(margin, evidence, words, kind):
    """What the logistic curve is over: worst margin, log evidence, log words, 1; and log evidence and 1 of the text's own cluster."""
    own, strength = np.eye(CLUSTERS)[kind], np.log(evidence + 0.05)
    return np.column_stack([margin, strength, np.log(words + 10.0), np.ones(len(margin)), own * strength[:, None], own])


def _with_inserted(words: list[str], rng) -> list[str]:
    """Each word with one character put in somewhere inside."""
    pool = "".join(words) or "x"
    out = []
    for w in words:
        i = int(rng.integers(1, len(w)))
        out.append(w[:i] + pool[int(rng.integers(len(pool)))] + w[i:])
    return out


def _spread_out(words: list[str], n: int) -> list[str]:
    """Farthest-first choice of landmarks under the kernel."""
    chosen = [words[0]]
    near = kernel(words, chosen)[:, 0]
    while len(chosen) < min(n, len(words)):
        chosen.append(words[int(near.argmin())])
        near = np.maximum(near, kernel(words, chosen[-1:])[:, 0])
    return list(dict.fromkeys(chosen))


def trained(positive: list[str], negative: list[str], hard: list[str], landmarks: int = LANDMARKS, seed: int = 3, goals: list[float] | None = None) -> WordMachine:
    """Nyström features and a linear machine with squared hinge loss, classes weighted alike; hard negatives come worst first. goals: the margin that each positive has to reach."""
    rng = np.random.default_rng(seed)
    marks = _spread_out(positive, landmarks) + [negative[i] for i in rng.choice(len(negative), min(landmarks, len(negative)), replace=False)]
    marks = list(dict.fromkeys(marks + hard[:landmarks]))
    negative = hard + negative
    words = positive + _with_inserted(positive, rng) + negative + _with_inserted(negative[: len(negative) // 4], rng)
    label = np.where(np.arange(len(words)) < 2 * len(positive), 1.0, -1.0)
    weight = np.where(label > 0, 0.5 / (label > 0).sum(), 0.5 / (label < 0).sum())
    goal = np.ones(len(words))
    if goals is not None:
        goal[: 2 * len(positive)] = np.tile(goals, 2)
    inner = kernel(marks, marks)
    values, basis = np.linalg.eigh(inner)
    keep = values > 1e-6 * values.max()
    whiten = basis[:, keep] / np.sqrt(values[keep])
    x = kernel(words, marks) @ whiten
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, 251):
        slack = np.maximum(0, goal - label * (x @ w + b))
        pull = -2 * weight * label * slack
        g = np.append(x.T @ pull + 2e-4 * w, pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    direction = whiten @ w
    total: dict[int, float] = {}
    for coefficient, own in zip(direction.tolist(), vectors(marks)):
        for u, value in own.items():
            total[u] = total.get(u, 0.0) + coefficient * value
    known = np.array(sorted(total), dtype=np.int64)
    return WordMachine(known, np.array([total[u] for u in known.tolist()]), float(b))


def worst_words(docs: DataFrame, machine: WordMachine) -> DataFrame:
    """docs with margin (of the worst window), evidence (sum of positive margins), words and kind (cluster) of each text, and score."""
    names = [c for c in docs.columns if c not in ("margin", "evidence", "words", "kind", "score")]
    kept = [c for c in names if c != "text"]

    def judge(batches):
        for batch in batches:
            margins, sums, counts, owners, texts, letters = np.full(len(batch), machine.bias), np.zeros(len(batch)), np.zeros(len(batch)), [], [], 0
            profiles = np.zeros((len(batch), PROFILE))
            for owner, text in [*pieces(batch["text"].to_pylist()), (None, "")]:
                if owner is not None:
                    profiles[owner] += _pairs(text)
                if texts and (owner is None or letters + len(text) > PIECE):
                    worst, evidence, words = machine.evidence(texts)
                    np.maximum.at(margins, owners, worst)
                    np.add.at(sums, owners, evidence)
                    np.add.at(counts, owners, words)
                    owners, texts, letters = [], [], 0
                owners.append(owner)
                texts.append(text)
                letters += len(text)
            kinds = machine.nearest(profiles)
            z = _terms(margins, sums, counts, kinds) @ machine.curve
            made = [pa.array(margins, pa.float64()), pa.array(sums), pa.array(counts), pa.array(kinds, pa.int32()), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *made], names=[*kept, "margin", "evidence", "words", "kind", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*names).mapInArrow(judge, f"{schema}, margin double, evidence double, words double, kind int, score double")


def labelled_sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER) -> DataFrame:
    """doc_id, text, toxic of the bounded training sample."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda kind, n: known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, most_toxic).union(pick(0, most_other))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")
    parts = F.filter(F.transform(F.split(F.lower("text"), r"[.\n]"), F.trim), lambda part: part != "")
    look = F.slice(F.array_sort(F.array_distinct(F.transform(parts, lambda part: F.xxhash64(part)))), 1, LOOK)
    first = F.min(F.struct("doc_id", "text")).alias("first")
    return saved(rows.groupBy(look.alias("look"), "toxic").agg(first).select("first.doc_id", "first.text", "toxic"), "labelled")


def _pairs(text: str) -> np.ndarray:
    """Counts of hashed pairs of successive characters."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.bincount((x[:-1] * 31 + x[1:]) * 40503 // 64 % PROFILE, minlength=PROFILE).astype(float)


def _profile(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of length one, or 0 without a pair."""
    return np.sqrt(counts / np.maximum(1.0, counts.sum(axis=-1, keepdims=True)))


def clustered(sample: DataFrame):
    """A function from counts of pairs (rows) to clusters, and the (other, toxic) texts of each: k-means of character pairs over the sample, without any language label."""

    def profiles(batches):
        for batch in batches:
            rows = [_profile(sum(_pairs(part) for _, part in pieces([text]))).tolist() for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    labelled = sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    rows = labelled.mapInArrow(profiles, f"doc_id {kind}, toxic int, x array<double>").orderBy("doc_id", "toxic").collect()
    x, toxic = np.array([r.x for r in rows]), np.array([r.toxic for r in rows])
    centres = x[:1]
    while len(centres) < CLUSTERS:
        centres = np.vstack([centres, x[(x @ centres.T).max(axis=1).argmin()]])
    for _ in range(20):
        own = (x @ centres.T).argmax(axis=1)
        means = np.array([x[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(CLUSTERS)])
        centres = means / np.maximum(1e-12, np.linalg.norm(means, axis=1, keepdims=True))
    own = (x @ centres.T).argmax(axis=1)
    counts = [(int((toxic[own == g] == 0).sum()), int((toxic[own == g] == 1).sum())) for g in range(CLUSTERS)]
    return lambda pairs: (_profile(pairs) @ centres.T).argmax(axis=-1), counts


def fitted(docs: DataFrame, labels: DataFrame) -> WordMachine | None:
    """A machine trained on the labelled sample; None if it lacks one of the two kinds, or no word tells them apart."""
    sample = labelled_sample(docs, labels)
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None

    nearest, per_cluster = clustered(sample)

    def words(batches):
        for batch in batches:
            for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
                own, single, parts = {}, set(), [part for _, part in pieces([text])]
                for part in parts:
                    joined, _, starts, ends, _, sizes = windows([part])
                    for a, b, size in zip(starts.tolist(), ends.tolist(), sizes.tolist()):
                        word = joined[a:b]
                        if len(word) <= LONGEST:
                            own[word] = True
                            if size == 1:
                                single.add(word)
                        for n in range(STEM, len(word) if size == 1 and len(word) <= LONGEST else 0):
                            own.setdefault(word[:n], False)
                            single.add(word[:n])
                kind = pa.array([int(nearest(sum(map(_pairs, parts))))] * len(own), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(own.values(), pa.bool_()), pa.array([w in single for w in own], pa.bool_()), pa.array([toxic] * len(own), pa.int32()), kind], names=["word", "whole", "single", "toxic", "kind"])

    found = sample.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(words, "word string, whole boolean, single boolean, toxic int, kind int")
    each = [F.sum((F.col("kind") == g).cast("int") * F.col("toxic")).alias(f"bad{g}") for g in range(CLUSTERS)] + [F.sum((F.col("kind") == g).cast("int") * (1 - F.col("toxic"))).alias(f"fine{g}") for g in range(CLUSTERS)]
    seen = saved(found.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"), F.max("whole").alias("whole"), F.max("single").alias("single"), *each), "words")
    texts = {"": (counts[0], counts[1])} | dict(enumerate(per_cluster))
    # One fourth of the chance each for words and for windows of several, in the whole sample and in all clusters together.
    sort = {"words": F.col("single"), "several": ~F.col("single")}
    sizes = seen.agg(*[F.count_if(of & (F.col(f"bad{g}") + F.col(f"fine{g}") > 0)).alias(f"{k}{g}") for k, of in sort.items() for g in texts]).first()
    told_by = F.lit(None).cast("double")  # the greatest odds of a group in which it is clear
    for g, (fine, bad) in texts.items():
        for k, of in sort.items() if fine and bad else ():
            tried = max(2, sizes[f"{k}{g}"]) * 4 * (1 if g == "" else CLUSTERS)
            n, share = F.col(f"bad{g}") + F.col(f"fine{g}"), bad / (fine + bad)
            x = F.col(f"bad{g}") / F.nullif(n, F.lit(0))
            apart = x * F.log(x / share) + F.when(x < 1, (1 - x) * F.log((1 - x) / (1 - share))).otherwise(0.0)
            odds = ((F.col(f"bad{g}") + 0.5) / (bad + 1)) / ((F.col(f"fine{g}") + 0.5) / (fine + 1))
            told_by = F.greatest(told_by, F.when(of & (x > share) & (n * apart >= float(np.log(tried / CHANCE))) & (odds >= ODDS), odds))
    told = saved(seen.withColumn("odds", told_by).filter("odds is not null").select("word", "bad", "odds"), "told")
    rows = told.orderBy(F.desc("bad"), "word").collect()
    positive, goals = [r.word for r in rows], [float(np.clip(np.log(r.odds) / np.log(CLEAR_ODDS), 0.3, 1.0)) for r in rows]
    known = frozenset(positive)
    # A window around a told word is no evidence against that word, so it is not among the negatives.
    around = lambda w: any(w[i:j] in known for i in range(len(w)) for j in range(i + LENGTH, len(w) + 1))
    others = saved(seen.filter("fine > 0 and whole").join(told.select("word"), "word", "left_anti").select("word", "single"), "others")
    negative = [r.word for of in sort.values() for r in others.filter(of).orderBy(F.xxhash64("word"), "word").limit(MOST_WORDS).collect() if r.single or not around(r.word)]
    if not positive or not negative:
        return None
    machine = trained(positive, negative, [], goals=goals)

    def judge(batches):
        for batch in batches:
            own, single = batch["word"].to_pylist(), batch["single"].to_pylist()
            margins = machine.margins(own)
            kept = [k for k, m in enumerate(margins.tolist()) if single[k] or m <= 0 or not around(own[k])]
            yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in kept], pa.string()), pa.array(margins[kept], pa.float64())], names=["word", "margin"])

    worst = others.mapInArrow(judge, "word string, margin double").orderBy(F.desc("margin"), "word").limit(MOST_WORDS // 2)
    machine = trained(positive, negative, [r.word for r in worst.collect()], goals=goals)
    machine.nearest = nearest
    rows = worst_words(sample, machine).select("doc_id", "toxic", "margin", "evidence", "words", "kind").orderBy("doc_id", "toxic").collect()
    y = np.array([r.toxic for r in rows], dtype=np.float64)
    # Logistic curve by Newton's steps: the rarer kind weighs the square root of what would make both alike; a ridge draws clusters to each other.
    x = _terms(*(np.array([r[c] for r in rows]) for c in ("margin", "evidence", "words", "kind")))
    beta = np.zeros(x.shape[1])
    weight = np.where(y > 0, np.sqrt((1 - y).sum() / y.sum()), 1.0)
    weight, ridge = weight / weight.sum(), np.diag([1e-4, 1e-4, 1e-4, 1e-9] + [SHARED] * (2 * CLUSTERS))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        beta = beta - np.linalg.solve(curve, x.T @ (weight * (p - y)) + ridge @ beta)
    machine.curve = beta
    return machine


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    machine = fitted(docs, labels)
    rows = docs.select("doc_id", "text", held_out(3, 1).alias("held_out"))
    if machine is None:
        out = rows.withColumn("score", F.lit(0.0))
    else:
        out = worst_words(rows, machine)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
