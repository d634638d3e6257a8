"""Language-model scoring with a gated recurrent network.

Counts. Token counts of all training documents come from one shuffle
aggregation and stay a table. The ``LISTED`` commonest words are known to every
task with their counts; all other words meet the count table in a shuffle join.

Model. The network reads and predicts symbols: the ``WORDS`` commonest words,
the end, and ``REST`` buckets that stand for all other words by their last two
bytes. A class-factored softmax gives a symbol's probability (class, then
symbol in its class; classes are runs of the symbols sorted by count). A word of
a bucket has the bucket's probability times (c + 1) / (n + v + 1), n and v being
the bucket's tokens and distinct words, so each unseen word has that of c = 0.

Training. ``ROUNDS`` rounds over disjoint parts of the training documents, by a
hash of id and text, so that copies under other ids spread over the rounds: each
task starts from the round's weights, runs truncated backpropagation through
windows of ``TRAIN_WINDOW`` tokens with states carried on, and the tasks' weights
are averaged by tokens, in blocks and in two steps, so that neither a group nor
the driver grows with the number of documents. Every training document trains
the weights once (``SHARE`` 1), as it counts once. Weights, and so ``score``,
depend on how Spark splits the rows into tasks (other columns do not): a test
holds the gain of one split against that of eight.

Texts are turned into symbols once, after the counts, and written; rounds and
scoring read these. Arrow splits the texts of a batch together, so that each of
their distinct words is looked up once.

Scoring. Documents are dealt to lanes that run side by side; a lane's state is
carried across windows and is zero at a document's start.

Cases: null and empty texts are the end token alone; very long texts are read
whole (one lane for each); repeated rows repeat and count in training; null
ids are training rows; without training rows every known count is 0; an empty
table gives an empty result; only id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks, frozen, id_bucket, segments

FOLDS, HELD_OUT = 7, 2
WORDS, REST, LISTED = 2048, 32, 1 << 17
HIDDEN, CLASSES, CLASS_SIZE = 16, 16, 160
WINDOW, LANES = 64, 256  # of scoring
TRAIN_WINDOW, TRAIN_LANES = 32, 128  # tokens a step: the two multiplied
ROUNDS, SHARE, RATE = 3, 1, 0.25
BUFFER_TOKENS = 1 << 21  # tokens that a task holds before it runs the lanes
COUNT_BYTES = 1 << 23  # of text whose words a task counts together before it hands them on
BLOCK = 1 << 13  # parameters in a block when tasks' weights are averaged
GROUP_TASKS = 256  # tasks whose weights meet in the first step of averaging
SEED = 11
SYMBOL = np.uint16  # WORDS, REST and the end fit
END = b""  # no word is empty


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts as they are, or one text by segments."""
    return ([part] for part in segments(texts[0])) if len(texts) == 1 else iter([texts])


def split_words(texts: list[bytes]) -> pa.ListArray:
    """Lower-cased (A-Z) words of each text, the end not among them; empty ones
    beside white space at a text's edge, or for a text without words, are to be
    left out."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))


def rest_bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % REST


def held_out_fold(doc_id: Column) -> Column:
    return F.coalesce(id_bucket(doc_id, FOLDS) == HELD_OUT, F.lit(False))


# ---------------------------------------------------------------- counts


def count_words(training: DataFrame) -> DataFrame:
    """(word, c) over all rows (t); the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = ends = 0

        def settled() -> pa.RecordBatch:
            counted = pa.chunked_array(held, pa.string()).value_counts()
            word, c = counted.field("values").view(pa.binary()), counted.field("counts")
            some = pc.not_equal(pc.binary_length(word), 0)
            word, c = pa.concat_arrays([word.filter(some), pa.array([END])]), pa.concat_arrays([c.filter(some), pa.array([ends])])
            return pa.RecordBatch.from_arrays([word, c], ["word", "c"])

        for batch in batches:
            for some in chunks(batch["t"].to_pylist()):
                ends += len(some)
                for part in pieces(some):
                    held.append(split_words(part).values)
                    size += sum(map(len, part))
                    if size > COUNT_BYTES:
                        yield settled()
                        held, size, ends = [], 0, 0
        if ends or held:
            yield settled()

    return training.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    """What every task knows of the counts; of bounded size."""

    listed: dict[bytes, int]  # word -> place
    symbol: np.ndarray  # by place
    log_count: np.ndarray  # log10(c + 1) by place
    is_rest: np.ndarray  # by symbol: whether it is a bucket
    rest_symbol: np.ndarray  # by bucket
    log_rest: np.ndarray  # log10(n + v + 1) by symbol, 0 for words
    mass: np.ndarray  # smoothed training tokens of each symbol, less 1
    end: int
    end_count: int
    total: int
    distinct: int

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, pa.Array, np.ndarray]]:
        """Symbols of all texts, each with its end, and how many are a text's;
        by text, log10 parts of base and model score that need no other words'
        counts, and known tokens; the words whose counts are not here, as rows
        of text, word and count."""
        n = len(texts)
        sizes, known = np.ones(n, np.int64), np.full(n, 1 if self.end_count else 0)
        base, extra = np.full(n, np.log10(self.end_count + 1)), np.zeros(n)
        symbols, rare = [], ([], [], [])
        for part in pieces(texts):
            words = split_words(part)
            distinct = words.values.dictionary_encode()
            names, of = distinct.dictionary.view(pa.binary()), distinct.indices.to_numpy()
            owner = np.repeat(np.arange(len(part)), np.diff(words.offsets.to_numpy()))
            if (empty := names.index(b"").as_py()) >= 0:
                owner, of = owner[of != empty], of[of != empty]
            # what a word adds, then what its tokens add to their texts
            at = np.fromiter(map(self.listed.get, names.to_numpy(zero_copy_only=False), repeat(-1)), np.int64, len(names))
            here = at >= 0
            symbol, log = np.empty(len(names), SYMBOL), np.zeros(len(names))
            symbol[here], log[here] = self.symbol[at[here]], self.log_count[at[here]]
            tails = pc.binary_slice(names.filter(pa.array(~here)), -2).dictionary_encode()
            buckets = np.fromiter(map(rest_bucket, tails.dictionary.to_pylist()), np.int64, len(tails.dictionary))
            symbol[~here] = self.rest_symbol[buckets[tails.indices.to_numpy()]]
            sizes += np.bincount(owner, minlength=n)
            known += np.bincount(owner[here[of]], minlength=n)
            base += np.bincount(owner, log[of], n)
            extra += np.bincount(owner, (np.where(self.is_rest[symbol], log, 0) - self.log_rest[symbol])[of], n)
            symbols.append(symbol[of])
            away = np.flatnonzero(~here[of])
            pair, count = np.unique(owner[away] * len(names) + of[away], return_counts=True)
            for kept, value in zip(rare, (pair // max(len(names), 1), names.take(pa.array(pair % max(len(names), 1))), count)):
                kept.append(value)
        base -= sizes * np.log10(self.total + self.distinct + 1)
        ends = np.cumsum(sizes) - 1
        out = np.empty(sizes.sum(), SYMBOL)
        inner = np.ones(len(out), bool)
        out[ends], inner[ends] = self.end, False
        out[inner] = np.concatenate(symbols)
        return out, sizes, base, extra, known, (np.concatenate(rare[0]), pa.concat_arrays(rare[1]), np.concatenate(rare[2]))

    def encode(self, text: bytes) -> tuple[np.ndarray, float, float, int, dict[bytes, int]]:
        """The same of one text."""
        symbols, _, base, extra, known, (_, words, counts) = self.encode_all([text])
        rare: dict[bytes, int] = {}
        for w, c in zip(words.to_pylist(), counts.tolist()):
            rare[w] = rare.get(w, 0) + c
        return symbols.astype(np.int32), float(base[0]), float(extra[0]), int(known[0]), rare


def lexicon(counts: DataFrame, words: int = WORDS, listed: int = LISTED) -> Lexicon:
    """From the count table; the driver gets ``listed`` words and sums by bucket."""
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    end = counts.where(F.col("word") == F.lit(END)).agg(F.sum("c").alias("c")).first()["c"] or 0
    # the least count that at most ``listed`` words reach, from the few distinct counts
    reached = counts.groupBy("c").agg(F.count(F.lit(1)).alias("words")).select("c", F.sum("words").over(Window.orderBy(F.desc("c"))).alias("reached"))
    least = reached.where(F.col("reached") <= listed).agg(F.min("c").alias("c")).first()["c"]
    chosen = counts.where((F.col("word") != F.lit(END)) & (F.col("c") >= (least if least is not None else sums["n"] or 0)))
    top = sorted(chosen.collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    names = [bytes(r["word"]) for r in top]
    c = np.array([r["c"] for r in top], np.int64)
    whole = (
        counts.where(F.col("word") != F.lit(END))
        .groupBy(F.crc32(F.substring("word", -2, 2)).alias("crc"))
        .agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
        .groupBy((F.col("crc") % REST).cast("int").alias("bucket"))
        .agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        .collect()
    )
    n, v = np.zeros(REST, np.int64), np.zeros(REST, np.int64)
    for r in whole:
        n[r["bucket"]], v[r["bucket"]] = r["n"], r["v"]
    buckets = np.array([rest_bucket(w) for w in names], np.int64).reshape(-1)
    np.subtract.at(n, buckets[:words], c[:words])
    np.subtract.at(v, buckets[:words], 1)
    # symbols by falling count: words, the end (-1), buckets (-2 - b)
    raw = [(int(x), i) for i, x in enumerate(c[:words])] + [(int(end), -1)] + [(int(x), -2 - b) for b, x in enumerate(n)]
    raw.sort(key=lambda x: (-x[0], x[1]))
    place = {name: s for s, (_, name) in enumerate(raw)}
    rest_symbol = np.array([place[-2 - b] for b in range(REST)], np.int32)
    symbol = np.array([place[i] if i < words else rest_symbol[buckets[i]] for i in range(len(names))], np.int32)
    is_rest, log_rest = np.zeros(len(raw), bool), np.zeros(len(raw))
    is_rest[rest_symbol] = True
    log_rest[rest_symbol] = np.log10(n + v + 1.0)
    mass = np.array([x for x, _ in raw], np.float64)
    mass[rest_symbol] += v  # as each word's 1 below, so that the untrained network equals the base
    return Lexicon(
        {w: i for i, w in enumerate(names)}, symbol, np.log10(c + 1.0), is_rest, rest_symbol, log_rest,
        mass, place[-1], int(end), int(sums["n"] or 0), int(sums["v"] or 0),
    )


# ---------------------------------------------------------------- network


def class_bounds(mass: np.ndarray) -> np.ndarray:
    """Starts of the classes: runs of symbols of about equal mass, none larger
    than CLASS_SIZE; ends with the number of symbols."""
    bounds, held, share = [0], 0.0, (mass.sum() + len(mass)) / CLASSES
    for i, m in enumerate(mass):
        if i - bounds[-1] and (held + m + 1 > share or i - bounds[-1] >= CLASS_SIZE):
            bounds.append(i)
            held = 0.0
        held += m + 1
    return np.array([*bounds, len(mass)])


class Network:
    """Gated recurrent network with a class-factored softmax."""

    NAMES = ("x", "u", "w", "wb", "c", "cb")

    def __init__(self, mass: np.ndarray, hidden: int = HIDDEN):
        self.bounds = class_bounds(mass)
        self.class_of = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int16), np.diff(self.bounds))
        rng, k, n = np.random.default_rng(SEED), len(mass), len(self.bounds) - 1
        share = (mass + 1) / (mass + 1).sum()
        of_class = np.add.reduceat(share, self.bounds[:-1])
        self.x = rng.normal(0, 0.1, (k, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.w = rng.normal(0, 0.05, (k, hidden)).astype(np.float32)
        self.wb = np.log(share / of_class[self.class_of]).astype(np.float32)
        self.c = rng.normal(0, 0.05, (n, hidden)).astype(np.float32)
        self.cb = np.log(of_class).astype(np.float32)
        self.hidden = hidden

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def by_gate(self, rows: np.ndarray) -> np.ndarray:
        """(gate, row, hidden) of rows of the gates side by side; the first two
        gates, which go through a sigmoid, negated."""
        gates = np.ascontiguousarray(rows.reshape(len(rows), 3, -1).transpose(1, 0, 2))
        np.negative(gates[:2], gates[:2])
        return gates

    def forward(self, inputs: np.ndarray, keep: np.ndarray, state: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (T, lanes, hidden) after each input; keep 0 forgets the state."""
        n, u = self.hidden, self.by_gate(self.u)
        given = self.by_gate(self.x).take(inputs, 1)
        states = np.empty((*inputs.shape, n), given.dtype)
        lanes, size = states[0].shape, len(inputs) if trace is not None else 1
        # each gate's values are contiguous, z and r replace what was given, and
        # then its sum with u the new state's; without a trace steps share arrays
        hu, before, news = np.empty((3, *lanes), given.dtype), np.empty((size, *lanes), given.dtype), np.empty((size, *lanes), given.dtype)
        if trace is not None:
            trace.extend((before, *given, news))
        forgets = (keep == 0).any(1)
        for t in range(len(inputs)):
            old, zr, new, h = before[t % size], given[:2, t], news[t % size], states[t]
            old[...] = state
            if forgets[t]:
                old[keep[t] == 0] = 0
            np.matmul(old, u, hu)
            zr += hu[:2]
            np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            np.multiply(zr[1], hu[2], new)
            new += given[2, t]
            np.tanh(new, new)
            if trace is not None:
                given[2, t] = hu[2]
            np.subtract(old, new, h)
            h *= zr[0]
            h += new
            state = h
        return states

    def output(self, h: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Natural log-probabilities of targets from rows of states; or, with
        ``grads``, the gradient of their negative sum by the states."""
        of = self.class_of[targets]
        order = np.argsort(of, kind="stable")  # rows of a class side by side
        h, targets, of = h[order], targets[order], of[order]
        at = np.arange(len(h))
        # choices by rows: sums over choices run along whole vectors
        p = self.c @ h.T
        p += self.cb[:, None]
        p -= p.max(0)
        out = p[of, at] if grads is None else None
        np.exp(p, out=p)
        total = p.sum(0)
        if grads is None:
            out -= np.log(total)
        else:
            p /= total
            p[of, at] -= 1
            grads["c"], grads["cb"] = p @ h, p.sum(1)
            dh = p.T @ self.c
            grads["w"], grads["wb"] = np.zeros_like(self.w), np.zeros_like(self.wb)
        edges = np.searchsorted(of, np.arange(len(self.bounds), dtype=of.dtype))
        for k in np.flatnonzero((np.diff(edges) > 0) & (np.diff(self.bounds) > 1)).tolist():
            lo, hi = self.bounds[k], self.bounds[k + 1]
            rows = slice(edges[k], edges[k + 1])
            hk, tk, ik = h[rows], targets[rows] - lo, at[: edges[k + 1] - edges[k]]
            p = self.w[lo:hi] @ hk.T
            p += self.wb[lo:hi, None]
            p -= p.max(0)
            if grads is None:
                out[rows] += p[tk, ik]
            np.exp(p, out=p)
            total = p.sum(0)
            if grads is None:
                out[rows] -= np.log(total)
            else:
                p /= total
                p[tk, ik] -= 1
                grads["w"][lo:hi], grads["wb"][lo:hi] = p @ hk, p.sum(1)
                dh[rows] += p.T @ self.w[lo:hi]
        back = np.empty_like(order)
        back[order] = at
        return (out[back], None) if grads is None else (None, dh[back])

    def backward(self, inputs: np.ndarray, keep: np.ndarray, trace: list, dstates: np.ndarray, grads: dict) -> None:
        n = self.hidden
        before, z, r, hun, new = trace
        by_new, by_z, by_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), hun * r * (1 - r)
        dg = np.empty((*inputs.shape, 3 * n), z.dtype)  # by the gates' sums with u
        dnew = np.empty_like(z)
        dh = np.zeros_like(dstates[0])
        for t in range(len(inputs) - 1, -1, -1):
            dh = dh + dstates[t]
            dnew[t] = dh * by_new[t]
            dg[t, :, :n] = dh * by_z[t]
            dg[t, :, n : 2 * n] = dnew[t] * by_r[t]
            dg[t, :, 2 * n :] = dnew[t] * r[t]
            dh = (dh * z[t] + dg[t] @ self.u.T) * keep[t][:, None]
        grads["u"] = before.reshape(-1, n).T @ dg.reshape(-1, 3 * n)
        dg[:, :, 2 * n :] = dnew
        flat = inputs.ravel()
        order = np.argsort(flat.astype(SYMBOL), kind="stable")
        given = flat[order]
        first = np.flatnonzero(np.concatenate(([True], given[1:] != given[:-1])))
        grads["x"] = (given[first], np.add.reduceat(dg.reshape(-1, 3 * n)[order], first, axis=0))

    def step(self, grads: dict, seen: dict, rate: float) -> None:
        """Adagrad."""
        for name, g in grads.items():
            value, past = getattr(self, name), seen[name]
            if name == "x":
                rows, g = g
                new = past[rows] + g * g
                past[rows] = new
                value[rows] -= rate * g / np.sqrt(new)
            else:
                past += g * g
                value -= rate * g / np.sqrt(past)


def lanes(documents: list[np.ndarray], width: int) -> list[list[int]]:
    """Documents (numbers) of each lane, the longest first to the emptiest
    lane; lanes by falling length."""
    import heapq

    heap = [(0, k) for k in range(min(width, len(documents)))]
    held: list[list[int]] = [[] for _ in heap]
    load = [0] * len(heap)
    for i in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
        size, k = heapq.heappop(heap)
        held[k].append(i)
        load[k] = size + len(documents[i])
        heapq.heappush(heap, (load[k], k))
    return [held[k] for k in sorted(range(len(held)), key=lambda k: -load[k])]


def run_lanes(net: Network, documents: list[np.ndarray], end: int, train: tuple[dict, float] | None = None) -> np.ndarray:
    """Natural log-probability of each document; trains on the way if asked to."""
    scores = np.zeros(len(documents))
    window, width = (TRAIN_WINDOW, TRAIN_LANES) if train else (WINDOW, LANES)
    dealt = lanes(documents, width)
    if not dealt:
        return scores
    # every lane's tokens one after the other, then by place in the lane: a
    # window is a run of these, as lanes are sorted by length
    doc = np.fromiter(chain.from_iterable(dealt), np.int32, len(documents))
    sizes = np.array([len(documents[i]) for i in doc])
    target, starts = np.concatenate([documents[i] for i in doc]), np.cumsum(sizes) - sizes
    long = np.array([sum(len(documents[i]) for i in held) for held in dealt])
    # lanes that reach a place, from how many end there
    width_at = len(long) - np.cumsum(np.bincount(long))[: long[0]]
    upto = np.concatenate(([0], np.cumsum(width_at)))
    # where each token goes
    place = np.concatenate([upto[:n] + k for k, n in enumerate(long.tolist())])
    given, keep = np.empty_like(target), np.ones(len(target), np.float32)
    given[place[1:]], given[place[starts]], keep[place[starts]] = target[:-1], end, 0
    target[place], owner = target.copy(), np.empty(len(target), np.int32)
    owner[place] = np.repeat(doc, sizes)
    del place
    state = np.zeros((len(dealt), net.hidden), np.float32)
    for at in range(0, len(width_at), window):
        size, live = min(window, len(width_at) - at), width_at[at]
        state = state[:live]
        run = slice(upto[at], upto[at + size])
        inputs, goes_on = given[run], keep[run]
        real = slice(None)
        if len(inputs) < size * live:  # some lanes end here
            real = (np.arange(live) < width_at[at : at + size, None]).ravel()
            inputs, goes_on = np.zeros(size * live, given.dtype), np.ones(size * live, np.float32)
            inputs[real], goes_on[real] = given[run], keep[run]
        inputs, goes_on = inputs.reshape(size, live), goes_on.reshape(size, live)
        if train is None:
            states = net.forward(inputs, goes_on, state)
            scores += np.bincount(owner[run], net.output(states.reshape(-1, net.hidden)[real], target[run])[0], len(scores))
        else:
            trace: list = []
            grads: dict = {}
            states = net.forward(inputs, goes_on, state, trace)
            dstates = np.zeros((size * live, net.hidden), np.float32)
            dstates[real] = net.output(states.reshape(-1, net.hidden)[real], target[run], grads)[1]
            net.backward(inputs, goes_on, trace, dstates.reshape(states.shape), grads)
            scale = np.float32(1 / live)
            net.step({n: (g[0], g[1] * scale) if n == "x" else g * scale for n, g in grads.items()}, *train)
        state = states[-1]
    return scores


# ---------------------------------------------------------------- training


def train_round(training: DataFrame, lex: Lexicon, weights: np.ndarray, rate: float) -> np.ndarray:
    """One round from ``weights`` over rows (symbols): the tasks' weights averaged."""
    mass, end = lex.mass, lex.end  # tasks need no words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(mass).load(weights)
        past = {n: np.full_like(getattr(net, n), 1e-2) for n in net.NAMES}
        held, size, seen = [], 0, 0
        for batch in batches:
            for document in map(unpacked, batch["symbols"].to_pylist()):
                held.append(document)
                size += len(document)
                if size > BUFFER_TOKENS:
                    run_lanes(net, held, end, (past, rate))
                    held, size, seen = [], 0, seen + size
        if held:
            run_lanes(net, held, end, (past, rate))
            seen += size
        if seen:
            flat = net.flat().astype(np.float64) * seen
            parts = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            group = TaskContext.get().partitionId() // GROUP_TASKS
            columns = [pa.array([group] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "block", "n", "v"])

    schema = "grp long, block long, n long, v binary"

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table["v"].to_pylist())
        return pa.table({"grp": [0], "block": table["block"][:1].to_pylist(), "n": [sum(table["n"].to_pylist())], "v": pa.array([total.tobytes()], pa.binary())})

    parts = training.mapInArrow(run, schema).groupBy("grp", "block").applyInArrow(add, schema)
    rows = parts.groupBy("block").applyInArrow(add, schema).collect()
    if not rows:
        return weights
    return np.concatenate([np.frombuffer(r["v"], np.float64) / r["n"] for r in sorted(rows, key=lambda r: r["block"])])


def train(training: DataFrame, lex: Lexicon, rounds: int = ROUNDS, share: int = SHARE, rate: float = RATE) -> np.ndarray:
    """Rows (part, symbols), each in one round."""
    weights = Network(lex.mass).flat()
    for k in range(rounds):
        weights = train_round(training.where(F.col("part") == k).select("symbols"), lex, weights, rate / (1 + k))
    return weights


# ---------------------------------------------------------------- symbols and scoring

ENCODED = "doc_id long, held_out boolean, part int, symbols binary, n_known long, base double, extra double, rare array<struct<word: binary, n: long>>"


def packed(symbols: np.ndarray) -> bytes:
    return symbols.astype(SYMBOL).tobytes()


def unpacked(symbols: bytes) -> np.ndarray:
    return np.frombuffer(symbols, SYMBOL)


def encoded_rows(documents: DataFrame, lex: Lexicon) -> DataFrame:
    """Rows (doc_id, held_out, part, t) as symbols, with the parts of both scores
    that need no other words' counts, and the words that need them."""
    names = [x.split()[0] for x in ENCODED.split(", ")[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in chunks(batch["t"].to_pylist()):
                symbols, sizes, base, extra, known, (owner, words, counts) = lex.encode_all(some)
                starts = np.concatenate(([0], np.cumsum(sizes))) * symbols.itemsize
                packs = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(symbols)])
                rare = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owner, np.arange(len(some) + 1)), pa.int32()),
                    pa.StructArray.from_arrays([words, pa.array(counts, pa.int64())], ["word", "n"]),
                )
                columns = [batch[n].slice(at, len(some)) for n in ("doc_id", "held_out", "part")]
                columns += [packs, pa.array(known, pa.int64()), pa.array(base), pa.array(extra), rare]
                at += len(some)
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.mapInArrow(run, ENCODED)


SCORED = "row long, doc_id long, held_out boolean, n_known long, base double, extra double, n_tokens long, model double"


def score_rows(encoded: DataFrame, lex: Lexicon, weights: np.ndarray) -> DataFrame:
    """Encoded rows with their number of tokens and the log10 probability of
    their symbols."""
    names = [x.split()[0] for x in SCORED.split(", ")]
    mass, end = lex.mass, lex.end  # tasks need no words

    def finish(net: Network, rows: list[tuple], held: list[np.ndarray]) -> pa.RecordBatch:
        scores = run_lanes(net, held, end) / np.log(10)
        columns = [*zip(*rows), list(map(len, held)), scores]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(mass).load(weights)
        rows, held, size = [], [], 0
        for batch in batches:
            given = zip(*(batch[n].to_pylist() for n in names[:-2]))
            for row, document in zip(given, map(unpacked, batch["symbols"].to_pylist())):
                rows.append(row)
                held.append(document)
                size += len(document)
                if size > BUFFER_TOKENS:
                    yield finish(net, rows, held)
                    rows, held, size = [], [], 0
        if held:
            yield finish(net, rows, held)

    return encoded.select(*names[:-2], "symbols").mapInArrow(run, SCORED)


def score(documents: DataFrame, rounds: int = ROUNDS, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model score of every row."""
    doc_id = F.col(id_col).cast("long")
    rows = documents.select(doc_id.alias("doc_id"), held_out_fold(doc_id).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    counts = frozen(count_words(rows.where(~F.col("held_out")).select("t")), "word-counts")
    lex = lexicon(counts)
    part = F.when(~F.col("held_out"), F.pmod(F.xxhash64("doc_id", "t"), F.lit(rounds * share)).cast("int"))
    encoded = frozen(encoded_rows(rows.withColumn("part", part), lex).withColumn("row", F.monotonically_increasing_id()), "symbols")
    weights = train(encoded.where(~F.col("held_out")), lex, rounds, share)
    scored = frozen(score_rows(encoded, lex, weights), "scored")
    # words outside the list are rare in training; those without a count add log10(1) to both scores
    sums = (
        encoded.select("row", F.explode("rare").alias("r"))
        .select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
        .join(counts, "word")
        .groupBy("row")
        .agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"))
    )
    seen, logs = F.coalesce("seen", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + seen).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + F.col("extra") + logs).alias("score"),
    )
