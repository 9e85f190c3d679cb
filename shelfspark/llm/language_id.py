"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on a
bounded sample of labelled documents.  It labels every byte position of the whole
text; a document's probabilities are the mean over its positions.

Texts are cut into segments, so that one step of the recurrence advances
thousands of segments at once.  The recurrence is not cut: each segment hands its
state over to the next one (backwards: to the one before), and the positions after
a seam are computed again until they agree with what was handed over.  So every
position sees the whole text on both sides, a long document is about as cheap
per byte as a short one, and memory does not grow with its length.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, map_batches, may_learn, smallest_hashes

#: Bytes of a segment in scoring and in training, and the symbol that fills the last one.
SEGMENT, SPAN, PAD = 512, 256, 256
#: Units per direction; segments that advance together.
UNITS, LANES = 6, 1024
#: Units (-1 to 1) that differ by less are taken as equal where a segment takes over from another; pooled
#: probabilities differ from those of unbroken texts by less than 1e-3.
SEAM = 1e-2
#: Bound of the training sample: rows and bytes of text, shared evenly by the labels.  Whole texts are read.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 32 << 20
#: Rows drawn of every label at least, as far as there are so many.
LABEL_DOCS = 20
#: Least number of steps, segments per step, rate of learning.
STEPS, BATCH, RATE = 160, 128, 0.03
UNKNOWN = "und"


def segments(text: bytes, size: int) -> np.ndarray:
    """A text as (number of segments, ``size``) symbols."""
    out = np.full(-(-len(text) // size) * size, PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(-1, size)


def has_letter(text: bytes) -> bool:
    """Whether a UTF-8 text holds a character of Unicode category L."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


class ByteGRU:
    """Parameters of both directions (axis 0) and of the position labeller.

    ``table``: what each symbol adds to the update, reset and candidate units; ``loop`` and ``bias``: the
    recurrent part; ``out`` and ``out_bias``: from the units of both directions to the labels.
    """

    def __init__(self, labels: list[str], units: int = UNITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.units = labels, units
        self.params = {
            "table": rng.normal(0, 0.3, (2, 3 * units, PAD + 1)),
            "loop": rng.normal(0, 1 / math.sqrt(units), (2, 3 * units, units)),
            "bias": np.zeros((2, units, 1)),
            "out": rng.normal(0, 1 / math.sqrt(units), (2, len(labels), units)),
            "out_bias": np.zeros((len(labels), 1)),
        }
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}
        # padding closes the update: the state stays as it is
        self.params["table"][:, :units, PAD], self.params["table"][:, units:, PAD] = 40, 0

    def _cell(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parameters of a direction, update and reset parts halved: sigmoid(x) = (1 + tanh(x / 2)) / 2."""
        table, loop = self.params["table"][d].copy(), self.params["loop"][d].copy()
        table[: 2 * self.units] *= np.float32(0.5)
        loop[: 2 * self.units] *= np.float32(0.5)
        return table, loop, self.params["bias"][d]

    def _advance(self, cell, symbols: np.ndarray, state: np.ndarray, work, kept: list | None = None) -> None:
        """One step of the recurrence, in place, for one symbol per lane."""
        (table, loop, bias), (given, back), h = cell, work, self.units
        half = np.float32(0.5)
        np.take(table, symbols, axis=1, out=given, mode="clip")
        np.matmul(loop, state, out=back)
        gates = given[: 2 * h]
        gates += back[: 2 * h]
        np.tanh(gates, out=gates)
        gates *= half
        gates += half
        inner = back[2 * h :]
        inner += bias
        if kept is not None:
            kept += [gates.copy(), inner.copy(), state.copy()]
        inner *= gates[h:]
        inner += given[2 * h :]
        np.tanh(inner, out=inner)
        if kept is not None:
            kept.append(inner.copy())
        state -= inner
        state *= gates[:h]
        state += inner

    def states(self, symbols: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Units of both directions, (2, steps, units, lanes), for symbols (steps, lanes); every lane starts at zero.

        keep: gets what backpropagation needs.
        """
        h = self.units
        steps, lanes = symbols.shape
        out = np.empty((2, steps, h, lanes), np.float32)
        for d in (0, 1):
            cell, state = self._cell(d), np.zeros((h, lanes), np.float32)
            work = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                kept = None if keep is None else []
                self._advance(cell, symbols[t], state, work, kept)
                if keep is not None:
                    keep[d, t] = tuple(kept)
                out[d, t] = state
        return out

    def hand_over(self, symbols: np.ndarray, states: np.ndarray, d: int, lanes: np.ndarray, entering: np.ndarray) -> None:
        """Make the states of direction ``d`` those of unbroken texts, in place.

        ``lanes`` are the segments with a predecessor in their text, in the order of direction ``d`` as +1 or -1
        lanes; ``entering`` (units, lanes of ``symbols``) is what each lane starts from where it is not zero.  A lane
        is computed again from what its predecessor hands over until its states agree with those it had; lanes that
        still differ at their end go on to their successors, so the sweeps end when no seam is open.
        """
        h, steps = self.units, len(symbols)
        order = range(steps) if d == 0 else range(steps - 1, -1, -1)
        cell, used, chained = self._cell(d), np.zeros_like(entering), np.zeros(symbols.shape[1], bool)
        chained[lanes] = True
        step = 1 if d == 0 else -1
        last = order[-1]
        live = np.nonzero(chained | (np.abs(entering).max(axis=0) > 0))[0]
        while len(live):
            start = np.where(chained[live], states[d, last][:, (live - step) % len(chained)], entering[:, live])
            differs = np.abs(start - used[:, live]).max(axis=0) > SEAM
            live, start = live[differs], np.ascontiguousarray(start[:, differs])
            used[:, live] = start
            state = start
            work = np.empty((3 * h, len(live)), np.float32), np.empty((3 * h, len(live)), np.float32)
            for k, t in enumerate(order):
                if not len(live):
                    break
                self._advance(cell, symbols[t, live], state, work)
                if k % 8 == 7:
                    open_ = np.abs(state - states[d, t][:, live]).max(axis=0) > SEAM
                    states[d, t][:, live] = state
                    if not open_.all():
                        live, state = live[open_], np.ascontiguousarray(state[:, open_])
                        work = np.empty((3 * h, len(live)), np.float32), np.empty((3 * h, len(live)), np.float32)
                else:
                    states[d, t][:, live] = state
            follow = live + step
            follow = follow[(follow >= 0) & (follow < len(chained))]
            live = follow[chained[follow]]

    def position_probabilities(self, symbols: np.ndarray, states: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of every position, (steps, labels, lanes)."""
        states = self.states(symbols) if states is None else states
        p = self.params
        scores = np.matmul(p["out"][0], states[0])
        scores += np.matmul(p["out"][1], states[1])
        scores += p["out_bias"]
        # the units lie in (-1, 1), so a score cannot leave this bound
        if float(np.abs(p["out"]).sum(axis=(0, 2)).max() + np.abs(p["out_bias"]).max()) > 60:
            scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        total = scores[:, 0].copy()
        for label in range(1, scores.shape[1]):
            total += scores[:, label]
        np.reciprocal(total, out=total)
        for label in range(scores.shape[1]):
            scores[:, label] *= total
        return scores

    def gradients(self, symbols: np.ndarray, truth: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over positions and its gradients, by backpropagation through time."""
        p, h = self.params, self.units
        steps, lanes = symbols.shape
        keep: dict = {}
        states = self.states(symbols, keep)
        probs = self.position_probabilities(symbols, states)
        valid = (symbols != PAD)[:, None, :].astype(np.float32)
        count = max(1.0, float(valid.sum()))
        rows = np.arange(lanes)
        loss = -float((np.log(probs[:, truth, rows] + 1e-9) * valid[:, 0]).sum()) / count
        delta = probs.copy()
        delta[:, truth, rows] -= 1
        delta *= valid / count
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["out_bias"] = delta.sum(axis=(0, 2))[:, None]
        for d in (0, 1):
            grads["out"][d] = np.einsum("tln,thn->lh", delta, states[d], optimize=True)
            from_out = np.matmul(p["out"][d].T, delta)
            carried = np.zeros((h, lanes), np.float32)
            pieces = np.empty((steps, 3 * h, lanes), np.float32)
            for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
                gates, inner, before, new = keep[d, t]
                update, reset = gates[:h], gates[h:]
                total = from_out[t] + carried
                d_new = total * (1 - update) * (1 - new * new)
                d_update = total * (before - new) * update * (1 - update)
                d_reset = d_new * inner * reset * (1 - reset)
                d_inner = d_new * reset
                back = np.concatenate((d_update, d_reset, d_inner))
                grads["loop"][d] += back @ before.T
                grads["bias"][d] += d_inner.sum(axis=1, keepdims=True)
                carried = total * update + p["loop"][d].T @ back
                pieces[t] = np.concatenate((d_update, d_reset, d_new))
            flat, wide = symbols.ravel(), pieces.transpose(1, 0, 2).reshape(3 * h, -1)
            for unit in range(3 * h):
                grads["table"][d][unit] = np.bincount(flat, wide[unit], PAD + 1)
        grads["table"][:, :, PAD] = 0  # fixed
        return loss, grads

    def fit(self, symbols: np.ndarray, truth: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam on mini-batches of segments; ``symbols`` is (segments, SPAN); errors travel back to a segment's ends.

        Every label has the same share of a batch, and the batches go on until every segment has been used.
        """
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        by_label = [np.nonzero(truth == k)[0] for k in range(len(self.labels))]
        by_label = [rng.permutation(x) for x in by_label if len(x)]
        share = -(-BATCH // len(by_label))
        steps = max(steps, -(-max(map(len, by_label)) // share))
        for step in range(1, steps + 1):
            turn = np.arange((step - 1) * share, step * share)
            pick = np.concatenate([x[turn % len(x)] for x in by_label])
            used = int((symbols[pick] != PAD).any(axis=0).sum())  # padding stands at the end
            _, grads = self.gradients(np.ascontiguousarray(symbols[pick, :used].T), truth[pick])
            norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            scale = min(1.0, 1.0 / (norm + 1e-12))
            rate = RATE * 0.5 * (1 + math.cos(math.pi * step / (steps + 1)))
            for k, g in grads.items():
                g = g * scale
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                step_size = rate / (1 - 0.9**step)
                self.params[k] -= (step_size * mean[k] / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _sums(self, rows: np.ndarray, owner: np.ndarray, entering: tuple[np.ndarray, np.ndarray] | None = None):
        """Summed probabilities per segment (labels, lanes) and the states that leave both ends.

        ``rows`` are consecutive segments of the texts ``owner`` (ascending); ``entering`` is what the first one
        starts from and what comes back into the last one.
        """
        symbols = np.ascontiguousarray(rows.T)
        states = self.states(symbols)
        for d in (0, 1):
            start = np.zeros((self.units, len(rows)), np.float32)
            if entering:
                start[:, 0 if d == 0 else -1] = entering[d]
            same = np.nonzero(owner[1:] == owner[:-1])[0]
            self.hand_over(symbols, states, d, same + 1 if d == 0 else same, start)
        probs = self.position_probabilities(symbols, states)
        ragged = np.nonzero(symbols[-1] == PAD)[0]
        probs[:, :, ragged] *= (symbols[:, ragged] != PAD)[:, None, :]
        return probs.sum(axis=0), (states[0, -1, :, -1].copy(), states[1, 0, :, 0].copy())

    def _long(self, text: bytes) -> np.ndarray:
        """Summed probabilities of a text of many segments: a pass from its end hands the backward states over, then one from its start."""
        block, none = LANES * SEGMENT, np.zeros(self.units, np.float32)
        starts = range(0, len(text), block)
        back = {starts[-1]: none}
        for at in reversed(starts[1:]):
            rows = segments(text[at : at + block], SEGMENT)
            back[at - block] = self._sums(rows, np.zeros(len(rows)), (none, back[at]))[1][1]
        total, forward = np.zeros(len(self.labels)), none
        for at in starts:
            rows = segments(text[at : at + block], SEGMENT)
            sums, (forward, _) = self._sums(rows, np.zeros(len(rows)), (forward, back[at]))
            total += sums.sum(axis=1)
        return total

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all positions of each text, (texts, labels)."""
        sums, lengths = np.zeros((len(texts), len(self.labels))), np.array([max(1, len(t)) for t in texts])
        queue, owners, waiting = [], [], 0

        def flush():
            nonlocal queue, owners, waiting
            rows, owner = np.concatenate(queue), np.concatenate(owners)
            queue, owners, waiting = [], [], 0
            heads = np.nonzero(np.diff(owner, prepend=-1))[0]
            sums[owner[heads]] += np.add.reduceat(self._sums(rows, owner)[0], heads, axis=1).T

        for k, text in enumerate(texts):
            if len(text) > LANES * SEGMENT:
                sums[k] = self._long(text)
            elif text:
                queue.append(segments(text, SEGMENT))
                owners.append(np.full(len(queue[-1]), k))
                waiting += len(queue[-1])
                if waiting >= LANES:
                    flush()
        if waiting:
            flush()
        return sums / lengths[:, None]


def train_language_model(
    df: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    id_col: str = "doc_id",
    most: int = SAMPLE_DOCS,
    most_bytes: int = SAMPLE_BYTES,
) -> ByteGRU | None:
    """Fit a network on about ``most`` labelled rows and ``most_bytes`` of text, drawn by a hash of id and text.

    Every label has an even share of both bounds, at least LABEL_DOCS rows and one text, so every trainable label is
    known.  Whole texts are learned from, however short.  Only rows outside the held-out fold with an id, a text and a label
    are drawn; None if there are none.  Of rows with the same id, text and label one is drawn; ties in the hash are
    decided by the id.  Other columns are not read, whatever their names.
    """
    able = df.filter(may_learn(id_col) & F.col(label_col).isNotNull() & (F.octet_length(F.col(text_col)) > 0))
    able = able.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    able = able.withColumn("h", F.xxhash64("id", "text"))
    n_labels = able.select("label").distinct().count()
    if not n_labels:
        return None
    order = Window.partitionBy("label").orderBy("h", "id")
    slim = able.select("id", "label", "h", F.octet_length("text").cast("long").alias("size"))
    share = able.select("label").distinct().withColumn("most", F.lit(max(LABEL_DOCS, most // n_labels)))
    drawn = smallest_hashes(slim, "label", "h", share)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("before", before).filter(F.col("before") < max(1, most_bytes // n_labels)).select("id", "label", "h").distinct()
    rows = able.join(F.broadcast(drawn), ["id", "label", "h"]).dropDuplicates(["id", "label", "h"]).select("id", "label", "text").collect()
    rows.sort(key=lambda r: (r.id, r.label, r.text))
    labels = sorted({r.label for r in rows})
    model = ByteGRU(labels)
    pieces = [segments(r.text.encode(), SPAN) for r in rows]
    truth = np.repeat([labels.index(r.label) for r in rows], [len(x) for x in pieces])
    model.fit(np.concatenate(pieces), truth)
    return model


def identify_language(df: DataFrame, model: ByteGRU | None, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its pooled probability) to every row.

    A null text or one without a letter (Unicode category L), or any text where no model could be trained, is ``und``
    with score 0.  Of labels with equal probabilities the first in code-point order is taken.  Repeated rows are judged
    alike, texts of any length are read whole, an empty table stays empty.  Added columns replace input columns of their names, others stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            texts = as_bytes(batch, text_col)
            known = [k for k, t in enumerate(texts) if t and model and has_letter(t)]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known:
                pooled = model.pooled([texts[k] for k in known])
                for k, best, row in zip(known, pooled.argmax(axis=1), pooled, strict=True):
                    names[k], scores[k] = model.labels[best], float(min(1.0, row[best]))
            yield batch, [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return map_batches(df, run, [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
