"""LM scoring by logistic context mixing, with a unigram base score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _LOWER, _SPACE, Words, blocks, bounded_batches, crc_mod, documents, first_of_runs, materialize, record_batch, text_bytes

#: Contexts: the last 0 to 4 bytes, and the current word so far (its last WORD_BYTES bytes). Those of less than
#: two bytes (orders 0 and 1, short words) have plain tables of 2**bits cells, which the byte alphabet fixes, those
#: of two bytes a sparse table; all longer ones are counted exactly in the tasks that own them.
CONTEXTS, WORD_BYTES = 6, 6
TABLE_BITS = (8, 16, 16)
#: Ends every text; no UTF-8 text has this byte.
END = 255
#: Sequences that a task works on at once, unless one owner has more, and rounds of teaching.
PORTION, ROUNDS = 12_500, 5
#: Added to both counts of a bit, and the largest logit of a prediction; weight of the first weights, in bits seen.
DELTA, CLIP, PRIOR = 0.1, 8.0, 4.0
BUCKETS = 24
#: Words and byte sequences that go to every executor: the most frequent ones, a fixed number. All others are joined.
HEAD_WORDS, HEAD_CODES = 1 << 17, 1 << 20

_TABLE_START = np.cumsum([0, *(1 << b for b in TABLE_BITS)])
_TABLE_OF = {0: 0, 1: 1, 5: 2}
#: Part of a code that holds a byte and the two before it.
TWO = (1 << 24) - 1


def ended(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with END after each."""
    docs = np.arange(len(offsets))
    out = np.full(len(raw) + len(docs) - 1, END, np.uint8)
    out[np.arange(len(raw)) + np.repeat(docs[:-1], np.diff(offsets))] = raw
    return out, offsets + docs


def gram_codes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte: itself in the lowest byte and what its contexts need of the bytes before it above that.

    These are the four bytes before, and up to WORD_BYTES bytes of the current word. Context bytes are in lower
    case; before a text there are zeros.
    """
    low, space = _LOWER[raw].astype(np.uint64), _SPACE[raw]
    code = raw.astype(np.uint64)
    at = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    in_word = np.ones(len(raw), bool)
    for k in range(1, WORD_BYTES + 1):
        before = np.zeros(len(raw), np.uint64)
        before[k:] = low[:-k]
        gap = np.ones(len(raw), bool)
        gap[k:] = space[:-k]
        in_word &= ~gap & (at >= k)
        before[~in_word if k > 4 else at < k] = 0
        code |= before << np.uint64(8 * k)
    return code


def contexts(code: np.ndarray) -> list[np.ndarray]:
    """The contexts of each code, as numbers. A word of two bytes has the byte before it in its context, so that
    every context of more than two bytes lies with one owner."""
    past = code >> np.uint64(8)
    out = [past & np.uint64((1 << 8 * k) - 1) for k in range(5)]
    word, alive = np.zeros(len(code), np.uint64), np.ones(len(code), bool)
    for k in range(WORD_BYTES):
        byte = (past >> np.uint64(8 * k)) & np.uint64(255)
        alive &= (byte != 0) & ~_SPACE[byte.astype(np.int64)]
        word |= np.where(alive, byte, 0).astype(np.uint64) << np.uint64(8 * k)
    two = (word >> np.uint64(8) > 0) & (word >> np.uint64(16) == 0)
    return [*out, np.where(two, past & np.uint64(TWO), word)]


def slots(context: np.ndarray, which: int, node: np.ndarray) -> np.ndarray:
    """Cell of a context of less than two bytes at a node of the current byte's bit tree."""
    return ((context << np.uint64(8)) | node).astype(np.int64) + _TABLE_START[_TABLE_OF[which]]


def bits_of(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The current byte's eight decisions: node of the bit tree (1 .. 255) and bit, highest first."""
    byte = code & np.uint64(255)
    for k in range(7, -1, -1):
        yield (byte | np.uint64(256)) >> np.uint64(k + 1), ((byte >> np.uint64(k)) & np.uint64(1)).astype(np.int64)


class Runs:
    """Exact counts of contexts of two bytes, from ``pairs``, and of longer ones, among sequences that hold all
    occurrences of them."""

    def __init__(self, context: list[np.ndarray], code: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]):
        self.keys, self.upto = pairs
        self.two, self.where = np.unique(code & np.uint64(TWO), return_inverse=True)
        self.sorted = []
        for which in range(3, CONTEXTS):
            key = (context[which] << np.uint64(8)) | (code & np.uint64(255))
            order = np.argsort(key, kind="stable")
            self.sorted.append((order, key[order], n[order]))

    def totals(self, depth: int) -> list[np.ndarray]:
        """How often each sequence's contexts were followed by the first ``depth`` bits of its byte."""
        low = self.two >> np.uint64(8 - depth) << np.uint64(8 - depth)
        ends = (self.upto[np.searchsorted(self.keys, x)] for x in (low, low + np.uint64(1 << 8 - depth)))
        out = [-np.subtract(*ends)[self.where]]
        for order, key, n in self.sorted:
            first = np.flatnonzero(first_of_runs(key >> np.uint64(8 - depth)))
            total = np.empty(len(n))
            total[order] = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(n))))
            out.append(total)
        return out


def _squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def stretch_counts(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + DELTA) / (n0 + DELTA)), -CLIP, CLIP)


@dataclass
class Mixer:
    """Frozen state: predictions of the short contexts, gated weights, and the final adaptive map.

    Two sets of weights are chosen for each bit: by the node of the bit tree, and by how well the longer contexts
    are known. Their logits are averaged; the map then refines the probability by node and bucket of the logit.
    Predictions of longer contexts come with the sequences to score, as counts.
    """

    table: np.ndarray
    by_node: np.ndarray
    by_known: np.ndarray
    refine: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.zeros(1))

    def inputs(self, code: np.ndarray, n: np.ndarray | None = None, counts=None) -> Iterator[tuple[np.ndarray, ...]]:
        """For each bit: node, bit, predictions of all contexts, and which weights they choose.

        ``n`` says how often each sequence was seen; without it longer contexts count as new. With the short
        contexts' ``counts``, predictions are as if one occurrence of the sequence had not been counted.
        """
        context = contexts(code)
        runs = None if n is None else Runs(context, code, n.astype(np.float64), self.pairs)
        less, short = int(counts is not None), np.flatnonzero(context[5] < 256)
        before = runs and runs.totals(0)
        for depth, (node, bit) in enumerate(bits_of(code)):
            x = np.zeros((len(code), CONTEXTS + 1), np.float32)
            if runs:
                after, sign = runs.totals(depth + 1), 2 * bit - 1
                for k in range(CONTEXTS - 2):
                    x[:, k + 2] = sign * stretch_counts(before[k] - after[k], np.maximum(after[k] - less, 0))
                before = after
            for which, rows in ((0, slice(None)), (1, slice(None)), (5, short)):
                at = slots(context[which][rows], which, node[rows])
                if counts is None:
                    x[rows, which] = self.table[at]
                else:
                    x[rows, which] = stretch_counts(np.maximum(counts[0][at] - (1 - bit[rows]), 0), np.maximum(counts[1][at] - bit[rows], 0))
            x[:, CONTEXTS] = 0.3
            known = np.zeros(len(code), np.int64)
            for which in range(2, CONTEXTS):
                sure = np.abs(x[:, which])
                known = known * 3 + (sure > 0) + (sure > 3)
            yield node.astype(np.int64), bit, x, known

    def logit(self, x, known, node):
        return 0.5 * ((x * self.by_node[node]).sum(axis=1) + (x * self.by_known[known]).sum(axis=1))

    def cell(self, logit):
        return np.clip(((logit + 12) * (BUCKETS / 24)).astype(np.int64), 0, BUCKETS - 1)

    def cost(self, code: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """Bits that each byte takes after its context."""
        total = np.zeros(len(code))
        for node, bit, x, known in self.inputs(code, n):
            logit = self.logit(x, known, node)
            p = 0.5 * (_squash(logit) + self.refine[node, self.cell(logit)])
            p = np.clip(p, 1e-5, 1 - 1e-5)
            total -= np.log2(np.where(bit == 1, p, 1 - p))
        return total

    def slopes(self, code: np.ndarray, n: np.ndarray, counts) -> np.ndarray:
        """What one step of teaching adds up: for every row of weights the slope and curvature of the coding cost
        (a row of 7 and the upper half of 7 x 7), and the cost itself at the end."""
        out = np.zeros((256 + len(self.by_known), len(_PAIRS) + CONTEXTS + 1))
        cost = 0.0
        for node, bit, x, known in self.inputs(code, n, counts):
            p = _squash(self.logit(x, known, node).astype(np.float64))
            cost -= (n * np.log(np.where(bit == 1, p, 1 - p))).sum()
            error, curve = n * (bit - p) * 0.5, n * p * (1 - p) * 0.25
            columns = [x[:, i] * error for i in range(CONTEXTS + 1)]
            columns += [x[:, i] * x[:, j] * curve for i, j in _PAIRS]
            for k, column in enumerate(columns):
                out[:256, k] += np.bincount(node, column, 256)
                out[256:, k] += np.bincount(known, column, len(self.by_known))
        return np.append(out.ravel(), cost)

    def outcomes(self, code: np.ndarray, n: np.ndarray, counts) -> np.ndarray:
        """Zeros and ones seen at every cell of the map."""
        out = np.zeros((2, 256 * BUCKETS))
        for node, bit, x, known in self.inputs(code, n, counts):
            cell = node * BUCKETS + self.cell(self.logit(x, known, node))
            for value in (0, 1):
                out[value] += np.bincount(cell, n * (bit == value), 256 * BUCKETS)
        return out.ravel()


_PAIRS = [(i, j) for i in range(CONTEXTS + 1) for j in range(i, CONTEXTS + 1)]


def step_of(sums: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Newton step of every row of weights; half of it, as the two sets answer for one error together."""
    k = CONTEXTS + 1
    curve = np.zeros((len(weights), k, k))
    for at, (i, j) in enumerate(_PAIRS):
        curve[:, i, j] = curve[:, j, i] = sums[:, k + at]
    slope = sums[:, :k] - PRIOR * 0.25 * (weights - first)
    return np.clip(0.5 * np.linalg.solve(curve + PRIOR * 0.25 * np.eye(k), slope[:, :, None])[:, :, 0], -0.5, 0.5)


# ---------------------------------------------------------------- learning

_GRAMS = pa.schema([("code", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])
#: Sequences that a task adds up before it passes them on.
HELD = 1 << 19


def _grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often byte sequences stand in texts that teach (n) and in texts to score (m), for some texts at a time."""

    def added(found):
        code, n, m = (np.concatenate(c) for c in zip(*found))
        code, where = np.unique(code, return_inverse=True)
        return record_batch(_GRAMS, code.view(np.int64), *(np.bincount(where, weights=x).astype(np.int64) for x in (n, m)))

    for batch in it:
        found, held = [], 0
        taught, asked = batch.column("taught"), batch.column("asked")
        for teaches in (True, False):
            for asks in (True, False) if teaches else (True,):
                on = pa.compute.and_(pa.compute.equal(taught, teaches), pa.compute.equal(asked, asks))
                raw, offsets = text_bytes(batch.column("text").filter(on))
                for i, j in blocks(offsets):
                    code = np.sort(gram_codes(*ended(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
                    at = np.flatnonzero(first_of_runs(code))
                    count = np.diff(np.append(at, len(code)))
                    found.append((code[at], count * teaches, count * asks))
                    held += len(at)
                    if held > HELD:
                        yield added(found)
                        found, held = [], 0
        if held:
            yield added(found)


_OWNED = pa.schema([("code", pa.binary()), ("n", pa.binary()), ("m", pa.binary())])


def _owned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their last three context bytes, packed: a row holds whole groups that agree in these."""
    held = np.zeros((3, 0), np.int64)

    def row(part):
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in part], schema=_OWNED)

    for batch in it:
        held = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("code", "n", "m")])], axis=1)
        if held.shape[1] >= PORTION:
            key = (held[0] >> 8) & TWO
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut:
                yield row(held[:, :cut])
                held = held[:, cut:]
    if held.shape[1]:
        yield row(held)


def _portions(it: Iterator[pa.RecordBatch], taught: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Packed rows as (code, n, m); with ``taught`` only what was seen in training."""
    for batch in it:
        for k in range(batch.num_rows):
            code, n, m = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("code", np.uint64), ("n", np.int64), ("m", np.int64)))
            if taught:
                code, n, m = code[n > 0], n[n > 0], m[n > 0]
            if len(code):
                yield code, n, m


_SUMS = pa.schema([("cell", pa.int32()), ("v", pa.float64())])


def _added(owned: DataFrame, f, size: int) -> np.ndarray:
    """Sum of ``f(code, n)``, an array of a fixed size, over all training text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for code, n, _ in _portions(it, True):
            sums += f(code, n)
        at = np.flatnonzero(sums)
        yield record_batch(_SUMS, at.astype(np.int32), sums[at])

    got = owned.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("cell").to_numpy()] = got.column("v").to_numpy()
    return out


_PAIR = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _pair_counts(owned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (two bytes of context, byte) of the training text and their running counts: a row for each that
    occurs, 2**24 at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n, _ in _portions(it, True):
            key, where = np.unique(code & np.uint64(TWO), return_inverse=True)
            yield record_batch(_PAIR, key.view(np.int64), np.bincount(where, weights=n).astype(np.int64))

    got = owned.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy().astype(np.float64)
    order = np.argsort(key)
    return key[order], np.concatenate([[0.0], np.cumsum(n[order])])


def _short_counts(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Zeros and ones seen at every cell of the short contexts."""
    context = contexts(code)
    out = np.zeros((2, int(_TABLE_START[-1])))
    for node, bit in bits_of(code):
        for which in _TABLE_OF:
            on = context[which] < 256
            at = slots(context[which][on], which, node[on])
            for value in (0, 1):
                out[value] += np.bincount(at, n[on] * (bit[on] == value), out.shape[1])
    return out.ravel()


def count_sequences(texts: DataFrame) -> DataFrame:
    """Every byte sequence of (text, taught, asked), how often it stands in texts that teach (n) and in texts to
    score (m), packed by owner.

    Sequences that agree in the last three context bytes have one owner, so all occurrences of a context of three
    bytes or more lie in one row. The table grows with the text; nothing is hashed or left out.
    """
    grams = texts.mapInArrow(_grams, "code long, n long, m long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    near = grams.withColumn("key", F.expr(f"shiftright(code, 8) & {TWO}")).repartition("key").sortWithinPartitions("key", "code").drop("key")
    return materialize(near.mapInArrow(_owned, "code binary, n binary, m binary"), "lm-grams")


def learn(owned: DataFrame) -> Mixer:
    """A mixer taught with every byte of the training text in ``owned``.

    Each round adds up slope and curvature of the cost of all training text in tasks, every byte left out of the
    counts that predict it; the driver solves for the weights of each gate, a fixed number. A round that made
    the cost worse is taken back by half. The adaptive map counts all training text likewise.
    """
    bc = owned.sparkSession.sparkContext.broadcast
    pairs = _pair_counts(owned)
    n0, n1 = _added(owned, _short_counts, 2 * int(_TABLE_START[-1])).reshape(2, -1)
    weight = np.full(CONTEXTS + 1, 0.3)
    weight[CONTEXTS] = 0
    first = np.tile(weight, (256 + 3 ** (CONTEXTS - 2), 1))

    def mixer(weights, refine=None):
        w = np.round(weights, 6).astype(np.float32)
        return Mixer(stretch_counts(n0, n1).astype(np.float32), w[:256], w[256:], np.full((256, BUCKETS), 0.5, np.float32) if refine is None else refine, pairs)

    if not n0.any() and not n1.any():
        return mixer(first)
    weights, best, least = first, first, np.inf
    step, size = np.zeros_like(first), len(first) * (len(_PAIRS) + CONTEXTS + 1) + 1
    for _ in range(ROUNDS):
        frozen = bc((mixer(weights), (n0, n1)))
        sums = _added(owned, lambda code, n, frozen=frozen: frozen.value[0].slopes(code, n, frozen.value[1]), size)
        if sums[-1] <= least:
            best, least = weights, sums[-1]
            step = step_of(sums[:-1].reshape(len(first), -1), weights, first)
        else:
            step = step / 2
        weights = best + step
    frozen = bc((mixer(best), (n0, n1)))
    zeros, ones = _added(owned, lambda code, n: frozen.value[0].outcomes(code, n, frozen.value[1]), 2 * 256 * BUCKETS).reshape(2, 256, BUCKETS)
    middle = _squash((np.arange(BUCKETS) + 0.5) * 24 / BUCKETS - 12)
    return mixer(best, ((ones + 30 * middle) / (zeros + ones + 30)).astype(np.float32))


# ---------------------------------------------------------------- scoring

_COSTS = pa.schema([("code", pa.int64()), ("m", pa.int64()), ("cost", pa.float32())])


def sequence_costs(owned: DataFrame, model: Mixer) -> DataFrame:
    """Bits of every byte sequence of the documents to score: each is mixed once."""
    frozen = owned.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n, m in _portions(it, False):
            cost, on = frozen.value.cost(code, n), m > 0
            yield record_batch(_COSTS, code[on].view(np.int64), m[on], cost[on].astype(np.float32))

    return owned.mapInArrow(run, "code long, m long, cost float")


def head_costs(costs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent sequences, HEAD_CODES at most, and their costs."""
    level = F.floor(F.log2("m") * 16).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in costs.groupBy(level.alias("level")).count().collect()), reverse=True)
    total = np.cumsum([k for _, k in sizes])
    fit = int((total <= HEAD_CODES).sum())
    least = sizes[fit - 1][0] if fit else 1 << 30
    got = costs.filter(level >= least).select("code", "cost").toArrow()
    code, cost = got.column("code").to_numpy().view(np.uint64), got.column("cost").to_numpy()
    order = np.argsort(code)
    return code[order], cost[order]


_WORDS = pa.schema([("h", pa.int64()), ("n", pa.int64())])


def _word_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        raw, offsets = text_bytes(batch.column("text"))
        found = [np.sort(Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True).hash) for i, j in blocks(offsets)]
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            if len(h):
                yield record_batch(_WORDS, h.view(np.int64), n)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether the wanted ones are there."""
    where = np.searchsorted(keys, wanted)
    return where, keys[np.minimum(where, len(keys) - 1)] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _lists(owner: np.ndarray, docs: int, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(docs + 1)).astype(np.int32), pa.array(values.view(np.int64)))


def _scored(head, total: float, vocabulary: float, end_count: float):
    """Per document: tokens, known tokens and base score as far as the head words tell, bits as far as the head
    sequences tell, and the other words' hashes and the other sequences."""
    floor = total + 0.1 * (vocabulary + 1)

    def log_share(c):
        return np.log10((c + 0.1) / floor)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, codes, costs = head.value
        for batch in it:
            raw, offsets = text_bytes(batch.column("text"))
            for i, j in blocks(offsets):
                own, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words = Words(own, at, lower=True)
                where, hit = _found(hashes, words.hash)
                value = np.zeros(len(words.hash))
                value[hit] = log_share(counts[where[hit]])
                base = np.bincount(words.doc, weights=value, minlength=j - i) + log_share(end_count)
                known = np.bincount(words.doc[hit], minlength=j - i) + (end_count > 0)
                rare = np.flatnonzero(~hit)
                size = np.diff(at)
                own, at = ended(own, at)
                code, back = np.unique(gram_codes(own, at), return_inverse=True)
                place, hit = _found(codes, code)
                cost = np.zeros(len(code))
                cost[hit] = costs[place[hit]]
                sums = np.zeros(len(own) + 1)
                np.cumsum(cost[back], out=sums[1:])
                other = np.flatnonzero(~hit[back])
                owner = np.searchsorted(at, other, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(words.counts + 1), pa.array(known), pa.array(base), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(size), _lists(words.doc[rare], j - i, words.hash[rare]), _lists(owner, j - i, code[back[other]])], names=["doc_id", "n_tokens", "known", "base", "bits", "n_bytes", "rare", "codes"])

    return run


def score_documents(docs: DataFrame, train: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unigram base score and the context mixer's score of every document of ``docs``, learned from ``train``:
    a table of its own, or a condition that the rows of ``docs`` meet which teach (each text is then read for both).

    The mixer predicts each bit of the text's bytes from six contexts: the last 0 to 4 bytes and the word so far. The contexts'
    bit counts, the weights, chosen by two gates, and the adaptive map behind them all cover all of ``train``;
    each byte is left out of the counts that teach weights and map. For scoring all state is frozen, so a document's
    score depends on its text and the model alone: total bits of its bytes and of the end after them, given as
    log10 probability.

    The HEAD_WORDS most frequent words and HEAD_CODES most frequent sequences go to the executors, all others are
    looked up by a join.

    Defined cases: null counts as the empty text, whose only token is the end and whose score is that of the end; if nothing
    was trained on, every bit has probability one half and no token is known; repeated rows are scored each; an
    empty table gives no rows; other columns are not read.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of an empty text: its bits).
    """
    spark = bounded_batches(docs).sparkSession
    text, yes, no = F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(True), F.lit(False)
    if isinstance(train, DataFrame):
        both = docs.select(text, no.alias("taught"), yes.alias("asked")).unionByName(train.select(text, yes.alias("taught"), no.alias("asked")))
    else:
        both = docs.select(text, F.coalesce(train, no).alias("taught"), yes.alias("asked"))
        train = docs.filter(train)
    texts = train.select(text)
    counts = materialize(texts.mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    n_train = train.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, vocabulary = sums["n"] + n_train, sums["v"] + (n_train > 0)
    top = counts.orderBy(F.desc("n"), "h").limit(HEAD_WORDS).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.float64)
    order = np.argsort(h)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    owned = count_sequences(both)
    costs = materialize(sequence_costs(owned, learn(owned)), "lm-costs")
    head = spark.sparkContext.broadcast((h[order], n[order], *head_costs(costs)))

    scored = rows.mapInArrow(_scored(head, float(total), float(vocabulary), float(n_train)), "doc_id long, n_tokens long, known long, base double, bits double, n_bytes long, rare array<long>, codes array<long>")
    scored = materialize(scored.withColumn("row_id", F.monotonically_increasing_id()), "lm-scored")
    floor = float(total) + 0.1 * (float(vocabulary) + 1)
    words = scored.select("row_id", F.explode("rare").alias("h")).join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = words.groupBy("row_id").agg(F.sum(F.log10((F.col("n") + 0.1) / floor)).alias("more"), F.sum((F.col("n") > 0).cast("long")).alias("more_known"))
    tail = scored.select("row_id", F.explode("codes").alias("code")).join(costs.select("code", "cost"), "code").groupBy("row_id").agg(F.sum("cost").alias("more_bits"))
    out = scored.drop("rare", "codes").join(rest, "row_id", "left").join(tail, "row_id", "left")
    bits = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    score = -bits * float(np.log10(2))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score"), (bits / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = crc_mod("doc_id", 10) == 0
    return score_documents(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
