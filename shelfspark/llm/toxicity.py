"""Toxicity: a linear-chain conditional random field over words.

Labels mark whole documents, so token labels come first: a word of a toxic
document is a toxic token if one of its features (the word, its beginnings and
endings) is far commoner in toxic documents than in others.  The random field is
trained on these labelled tokens (forward-backward, numpy) and generalises by
the word features and by its transitions.  In scoring, forward-backward marginals
tag the toxic spans of the whole text, and a logistic model aggregates them to a
document score.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, map_batches, may_learn, smallest_hashes

WORD = re.compile(r"\w+")
#: Pieces of a chain that advance together have so many words, and so many pieces are one block.  The pieces hand the
#: messages of the random field over, so results are those of unbroken chains.
PIECE, LANES = 48, 8192
#: Bound of the training sample: this many labelled documents of the toxic class and of the other.
SAMPLE_TOXIC, SAMPLE_CLEAN = 700, 1400
#: A feature marks toxic tokens if its rate of toxic documents is RATIO times that of others and it is in so many
#: toxic documents that one in CHANCE such features would occur in toxic ones alone by chance.
RATIO, CHANCE = 12.0, 1e6
#: Documents a feature must be in to get a weight.
SEEN = 8
ROUNDS, RATE, DECAY = 25, 0.5, 1e-3
#: Lengths of beginnings and of the ending.
PREFIXES, SUFFIX = (4, 5, 6), 4
#: Words whose emission a task remembers.
CACHE = 400_000


def features(word: str) -> list[str]:
    """Features of a lower-cased word: itself, its beginnings and its ending."""
    n = len(word)
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if n >= k), *(["$" + word[-SUFFIX:]] if n > SUFFIX else [])]


class Emissions(dict):
    """Word to emission score; words met for the first time are scored from their features."""

    def __init__(self, weights: dict[str, float], bias: float):
        super().__init__()
        self.bias = bias
        self.whole, self.begin, self.end = ({f[1:]: v for f, v in weights.items() if f[0] == k} for k in "=^$")

    def __missing__(self, word: str) -> float:
        n, begin = len(word), self.begin
        value = self.bias + self.whole.get(word, 0.0)
        for k in PREFIXES:
            if n >= k:
                value += begin.get(word[:k], 0.0)
        if n > SUFFIX:
            value += self.end.get(word[-SUFFIX:], 0.0)
        if len(self) < CACHE:
            self[word] = value
        return value


def unlike(words: list[list[str]], draws: int = 4) -> list[int]:
    """Positions of documents that share no minimum of ``draws`` hashes of their word triples with an earlier one.

    Copies of one toxic document would make all its words look toxic.
    """
    seen: set[tuple[int, int]] = set()
    kept = []
    factors = np.random.default_rng(3).integers(1, 2**62, draws, dtype=np.uint64) * 2 + 1
    for k, ws in enumerate(words):
        triples = {zlib.crc32(" ".join(ws[i : i + 3]).encode()) for i in range(max(1, len(ws) - 2))}
        hashes = np.fromiter(triples, np.uint64, len(triples))
        keys = {(d, int((hashes * f >> np.uint64(20)).min())) for d, f in enumerate(factors)}
        if not keys & seen:
            kept.append(k)
        seen |= keys
    return kept


class Chains:
    """Chains (documents) laid out as pieces in columns: (PIECE, pieces)."""

    def __init__(self, lengths: np.ndarray):
        pieces = -(-lengths // PIECE)
        self.n = int(pieces.sum())
        firsts = np.concatenate(([0], np.cumsum(pieces)[:-1])).astype(np.int64)
        inside = np.arange(int(lengths.sum())) - np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        # token -> place in a (PIECE, n) grid
        self.places = (inside % PIECE) * self.n + np.repeat(firsts, lengths) + inside // PIECE
        #: pieces of a chain in turn: the first ones, the second ones of chains that have two, ...
        self.turns = []
        live, k = firsts[pieces > 0], 0
        counts = pieces[pieces > 0]
        while len(live):
            self.turns.append(live)
            k += 1
            live, counts = live[counts > k] + 1, counts[counts > k]
        self.first = np.zeros(self.n, bool)
        self.first[firsts[pieces > 0]] = True
        self.filled = np.zeros((PIECE, self.n), bool)
        self.filled.ravel()[self.places] = True

    def grid(self, values: np.ndarray, pad: float) -> np.ndarray:
        out = np.full((PIECE, self.n), pad, values.dtype)
        out.ravel()[self.places] = values
        return out


def _products(odds: np.ndarray, move: np.ndarray, chains: Chains) -> np.ndarray:
    """Product of the transfer matrices of each piece, (2, 2, pieces), scaled; a chain's first word has no transition."""
    out = np.empty((2, 2, odds.shape[1]))
    out[0, 0], out[0, 1] = np.where(chains.first, 1, move[0, 0]), np.where(chains.first, 0, move[0, 1]) * odds[0]
    out[1, 0], out[1, 1] = np.where(chains.first, 0, move[1, 0]), np.where(chains.first, 1, move[1, 1]) * odds[0]
    for t in range(1, PIECE):
        on = chains.filled[t]
        zero = out[:, 0] * move[0, 0] + out[:, 1] * move[1, 0]
        one = (out[:, 0] * move[0, 1] + out[:, 1] * move[1, 1]) * odds[t]
        scale = 1 / (zero + one).sum(axis=0)
        out[:, 0], out[:, 1] = np.where(on, zero * scale, out[:, 0]), np.where(on, one * scale, out[:, 1])
    return out


def marginals(emissions: np.ndarray, transitions: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over whole chains: the marginals of state 1, (PIECE, pieces), and the summed pairwise ones (2, 2).

    The score of state 1 is the emission, that of state 0 is 0; ``transitions`` holds log weights.  The product
    of a piece's transfer matrices takes a message across it, so each piece starts from the message of all words before
    it and ends with that of all words after it.
    """
    n = chains.n
    move = np.exp(transitions)
    enter, leave = np.ones((2, n)), np.ones((2, n))
    if len(chains.turns) > 1:
        product = np.empty((2, 2, n))
        for at in range(0, n, LANES):
            part = slice(at, at + LANES)
            product[:, :, part] = _products(np.exp(np.clip(emissions[:, part], -30, 30)), move, _part(chains, part))
        for turn in chains.turns[1:]:
            moved = (enter[:, None, turn - 1] * product[:, :, turn - 1]).sum(axis=0)
            enter[:, turn] = moved / moved.sum(axis=0)
        for turn in reversed(chains.turns[1:]):
            moved = (product[:, :, turn] * leave[None, :, turn]).sum(axis=1)
            leave[:, turn - 1] = moved / moved.sum(axis=0)
    out, pairs = np.empty(emissions.shape), np.zeros((2, 2))
    for at in range(0, n, LANES):
        part = slice(at, at + LANES)
        odds = np.exp(np.clip(emissions[:, part], -30, 30))
        out[:, part], more = _forward_backward(odds, move, _part(chains, part), enter[:, part], leave[:, part])
        pairs += more
    return out, pairs


def _part(chains: Chains, part: slice) -> Chains:
    out = object.__new__(Chains)
    out.first, out.filled = chains.first[part], chains.filled[:, part]
    return out


def _forward_backward(odds, move, chains, enter, leave) -> tuple[np.ndarray, np.ndarray]:
    steps, lanes = odds.shape
    forward, backward = np.empty((steps, 2, lanes)), np.empty((steps, 2, lanes))
    before = enter
    for t in range(steps):
        zero, one = before[0] * move[0, 0] + before[1] * move[1, 0], before[0] * move[0, 1] + before[1] * move[1, 1]
        if t == 0:
            zero, one = np.where(chains.first, before[0], zero), np.where(chains.first, before[1], one)
        forward[t, 0], forward[t, 1] = zero, one * odds[t]
        forward[t] /= forward[t].sum(axis=0)
        before = forward[t]
    pairs = np.zeros((2, 2))
    after = leave
    for t in range(steps - 1, -1, -1):
        # the last word of a piece takes the message that comes back into it
        on = chains.filled[t]
        backward[t] = after
        source = forward[t - 1] if t else enter
        a, b = after[0], after[1] * odds[t]
        joint = source[:, None] * move[:, :, None] * np.stack((a, b))[None]
        joint /= joint.sum(axis=(0, 1))
        pairs += (joint * (on & ~chains.first if t == 0 else on)).sum(axis=2)
        moved = np.stack((move[0, 0] * a + move[0, 1] * b, move[1, 0] * a + move[1, 1] * b))
        after = np.where(on, moved / moved.sum(axis=0), leave)
    one = forward[:, 1] * backward[:, 1]
    return one / (one + forward[:, 0] * backward[:, 0]), pairs


class ToxicityModel:
    """Weights of the random field and of the document score."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias, self.transitions = -8.0, np.zeros((2, 2))
        self.document = np.array([-6.0, 8.0, 0.0])

    def token_marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Marginal of each token of concatenated documents."""
        chains = Chains(lengths)
        return marginals(chains.grid(emissions, 0.0), self.transitions, chains)[0].ravel()[chains.places]

    def document_features(self, probabilities: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(1, greatest marginal, log of 1 + expected toxic tokens) of each document."""
        out = np.zeros((len(lengths), 3))
        out[:, 0] = 1
        some = np.nonzero(lengths)[0]
        if len(some):
            heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))[some]
            out[some, 1] = np.maximum.reduceat(probabilities, heads)
            out[some, 2] = np.log1p(np.add.reduceat(probabilities, heads))
        return out

    def scores(self, document_features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features @ self.document, -30, 30)))

    def fit(self, texts: list[str], toxic: list[int]) -> ToxicityModel:
        """Label tokens, train the field on them, then the document score."""
        words = [WORD.findall(t.lower()) for t in texts]
        kept = unlike(words)
        words, toxic = [words[k] for k in kept], [toxic[k] for k in kept]
        number: dict[str, int] = {}
        tokens = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
        lengths, truth = np.array([len(ws) for ws in words]), np.array(toxic)
        if not len(tokens) or truth.all() or not truth.any():
            self.document = np.array([8.0 if len(truth) and truth.all() else -8.0, 0.0, 0.0])
            return self
        docs = np.repeat(np.arange(len(words)), lengths)
        seen: dict[str, int] = {}
        of_word = [[seen.setdefault(f, len(seen)) for f in features(w)] for w in number]
        flat, owner = np.array([f for fs in of_word for f in fs]), np.repeat(np.arange(len(of_word)), [len(x) for x in of_word])
        by_doc = np.unique(docs * len(number) + tokens)
        doc_of, word_of = by_doc // len(number), by_doc % len(number)
        spread = np.array([len(x) for x in of_word])
        first = np.concatenate(([0], np.cumsum(spread)[:-1]))
        picks = np.repeat(first[word_of] - np.concatenate(([0], np.cumsum(spread[word_of])[:-1])), spread[word_of]) + np.arange(spread[word_of].sum())
        pairs = np.unique(np.repeat(doc_of, spread[word_of]) * len(seen) + flat[picks])
        in_toxic = truth[pairs // len(seen)] == 1
        n1, n0 = truth.sum(), len(truth) - truth.sum()
        df1 = np.bincount(pairs[in_toxic] % len(seen), minlength=len(seen))
        df0 = np.bincount(pairs[~in_toxic] % len(seen), minlength=len(seen))
        ratio = ((df1 + 0.5) / (n1 + 1)) / ((df0 + 0.5) / (n0 + 1))
        least = math.ceil(math.log(CHANCE) / math.log(len(truth) / n1))
        marks = (df1 >= least) & (ratio >= RATIO)
        toxic_word = np.bincount(owner, marks[flat], len(number)) > 0
        labels = (toxic_word[tokens] & (truth[docs] == 1)).astype(np.float64)
        used = (df1 + df0) >= SEEN
        self._train(tokens, lengths, labels, flat, owner, used, len(seen))
        self.weights = {f: float(self._theta[k]) for f, k in seen.items() if used[k] and abs(self._theta[k]) > 1e-3}
        del self._theta
        emissions = np.fromiter(map(Emissions(self.weights, self.bias).__getitem__, chain.from_iterable(words)), float, len(tokens))
        self._fit_document(self.document_features(self.token_marginals(emissions, lengths), lengths), truth)
        return self

    def _train(self, tokens, lengths, labels, flat, owner, used, n_features) -> None:
        """Adagrad on the negative log-likelihood of the labelled chains."""
        n_words = int(owner[-1]) + 1
        theta, bias, move = np.zeros(n_features), -4.0, np.zeros((2, 2))
        seen_theta, seen_bias, seen_move = np.full(n_features, 1e-8), 1e-8, np.full((2, 2), 1e-8)
        chains = Chains(lengths)
        count = max(1.0, labels.sum())
        inner = np.ones(len(labels), bool)
        inner[np.concatenate(([0], np.cumsum(lengths)[:-1]))[lengths > 0]] = False  # tokens with one before them
        states = labels.astype(int)
        observed = np.bincount((states[:-1] * 2 + states[1:])[inner[1:]], minlength=4).reshape(2, 2)
        usable = used[flat]
        for _ in range(ROUNDS):
            word_scores = bias + np.bincount(owner, theta[flat] * usable, n_words)
            probabilities, expected = marginals(chains.grid(word_scores[tokens], 0.0), move, chains)
            error = (probabilities.ravel()[chains.places] - labels) / count
            by_word = np.bincount(tokens, error, n_words)
            slope = np.bincount(flat, by_word[owner] * usable, n_features) + DECAY * theta / count
            slope_bias, slope_move = by_word.sum(), (expected - observed) / count
            slope_move[0, 0] = 0.0
            seen_theta += slope**2
            seen_bias += slope_bias**2
            seen_move += slope_move**2
            theta -= RATE * slope / np.sqrt(seen_theta)
            bias -= RATE * slope_bias / math.sqrt(seen_bias)
            move -= RATE * slope_move / np.sqrt(seen_move)
        self._theta, self.bias, self.transitions = theta, bias, move

    def _fit_document(self, x: np.ndarray, truth: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge; both classes weigh alike."""
        weight = np.where(truth == 1, 0.5 / max(1, truth.sum()), 0.5 / max(1, (1 - truth).sum())) * len(truth)
        beta = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (weight * (p - truth)) + 0.1 * beta
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
            beta -= np.linalg.solve(curve, slope)
        self.document = beta


def train_toxicity_model(
    df: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "toxic",
    most: tuple[int, int] = (SAMPLE_CLEAN, SAMPLE_TOXIC),
) -> ToxicityModel:
    """Fit a model on at most ``most`` rows labelled clean and toxic, drawn by a hash of id and text.

    Only rows outside the held-out fold with an id, a text and a label of 0 or 1 are drawn; an id with both labels counts
    as toxic.  Of rows with the same id and text one is drawn; ties in the hash are decided by the id.  Whole texts
    are learned from, of any length, empty ones included.  Without labelled rows of both classes, as in empty tables,
    every text gets the same score.  Other columns are not read, whatever their names.
    """
    known = labels.filter(may_learn(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    texts = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("id", "text"))
    keys = texts.select("id", "h").join(known, "id")
    bounds = df.sparkSession.createDataFrame([(0, most[0]), (1, most[1])], "label int, most int")
    sample = smallest_hashes(keys.withColumn("label", F.col("label").cast("int")), "label", "h", bounds).distinct()
    rows = texts.join(F.broadcast(sample), ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "label", "text").collect()
    rows.sort(key=lambda r: (r.id, r.text))
    return ToxicityModel().fit([r.text for r in rows], [int(r.label) for r in rows])


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
)


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``toxic_spans`` (code points, end exclusive, greatest marginal) to every row.

    Adjacent tokens with a marginal of at least one half form a span.  Null and empty texts have the score of a
    text without toxic tokens and no spans.  Repeated rows are scored alike, texts of any length are read whole
    as one chain, an empty table stays empty.  Added columns replace input columns of their names, others stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        emission = Emissions(model.weights, model.bias).__getitem__
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in as_bytes(batch, text_col)]
            scores, spans = [], []
            for group in _groups(texts):
                words = [WORD.findall(t.lower()) for t in group]
                lengths = np.array([len(ws) for ws in words])
                total = int(lengths.sum())
                values = np.fromiter(map(emission, chain.from_iterable(words)), float, total)
                p = model.token_marginals(values, lengths) if total else values
                scores += model.scores(model.document_features(p, lengths)).tolist()
                at = 0
                for text, n in zip(group, lengths, strict=True):
                    spans.append(_spans(text, p[at : at + n]))
                    at += n
            yield batch, [pa.array(scores, pa.float64()), pa.array(spans, kind)]

    return map_batches(df, run, [T.StructField("score", T.DoubleType(), False), T.StructField("toxic_spans", SPANS, False)])


def _groups(texts: list[str], chars: int = 2_000_000):
    """Consecutive texts of about ``chars`` characters together."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def _spans(text: str, p: np.ndarray) -> list[dict]:
    hot = np.nonzero(p >= 0.5)[0]
    if not len(hot):
        return []
    wanted, out, last = set(hot.tolist()), [], -2
    # lower() may change a text's length, so offsets come from the text itself
    for k, found in enumerate(WORD.finditer(text)):
        if k in wanted:
            if k == last + 1:
                out[-1] |= {"end": found.end(), "p": max(out[-1]["p"], float(p[k]))}
            else:
                out.append({"start": found.start(), "end": found.end(), "p": float(p[k])})
            last = k
    return out
