"""Language-model scores by a gated recurrent network in numpy.

Vocabulary: the VOCABULARY most frequent training tokens, in classes of equal size by rank; the output
is the class's softmax times the word's within its class. All other words share one token, times the word's
add-one share among them, so every text has a probability. Word counts, and with them the
sums over all words, are taken over the whole corpus by Spark.

Training passes once over all training documents in rounds of growing shares; in a round each task
trains on its own documents from the present weights by truncated backpropagation (WINDOW tokens, the
state carried on from window to window through the whole document), and the tasks' weights are averaged by
the tokens they saw. Training and scoring alike start a document from the end token and a state of zero.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textscan as ts
from ledgerloom.session import cut

CLASS_SIZE = 32
CLASSES = 32
VOCABULARY = CLASS_SIZE * CLASSES - 1  # and the token of all other words
UNKNOWN = VOCABULARY
HIDDEN = 16
WINDOW = 32
TRAIN_ROWS, SCORE_ROWS = 512, 2048
#: Shares of the training documents (in sixteenths, by hash) that the rounds use, one after the other.
ROUNDS = ((0, 1), (1, 4), (4, 16))
RATE = 0.02
#: Most words whose counts are sent to all tasks; the rarer ones are looked up by a join.
HEAD_WORDS = 1 << 19
#: Most partial averages that reach the driver in a round.
PARTIALS = 32
END = np.uint64(0x5EED0F7E57E4D000)


# --- the network ----------------------------------------------------------------------------


def new_weights(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; the output's biases give the tokens' overall shares."""
    rng = np.random.default_rng(11)
    share = np.log(np.maximum(counts, 0.5).reshape(CLASSES, CLASS_SIZE))
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "x": small(CLASSES * CLASS_SIZE, 3 * HIDDEN),
        "u": small(HIDDEN, 3 * HIDDEN) * 3,
        "wc": small(HIDDEN, CLASSES),
        "bc": (np.logaddexp.reduce(share, axis=1)).astype(np.float32),
        "wv": small(CLASSES, HIDDEN, CLASS_SIZE),
        "bv": share.astype(np.float32),
    }


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unflat(data: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = data[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _step(w: dict, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    g = w["x"][ids]
    hu = h @ w["u"]
    zr = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
    return n + z * (h - n), z, r, n, hu[:, 2 * HIDDEN :]


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(targets // CLASS_SIZE, kind="stable")
    return order, np.searchsorted(targets[order] // CLASS_SIZE, np.arange(CLASSES + 1))


def log_probabilities(w: dict, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithms, class times word."""
    a = h @ w["wc"] + w["bc"]
    out = a[np.arange(len(a)), targets // CLASS_SIZE] - np.log(np.exp(a).sum(axis=1))
    order, edges = _by_class(targets)
    for k in range(CLASSES):
        rows = order[edges[k] : edges[k + 1]]
        if len(rows):
            b = h[rows] @ w["wv"][k] + w["bv"][k]
            out[rows] += b[np.arange(len(rows)), targets[rows] % CLASS_SIZE] - np.log(np.exp(b).sum(axis=1))
    return out


def _output_gradients(w: dict, h: np.ndarray, targets: np.ndarray, grads: dict, scale: np.float32) -> np.ndarray:
    a = h @ w["wc"] + w["bc"]
    p = np.exp(a - a.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(p)), targets // CLASS_SIZE] -= 1
    p *= scale
    grads["wc"] += h.T @ p
    grads["bc"] += p.sum(axis=0)
    dh = p @ w["wc"].T
    order, edges = _by_class(targets)
    for k in range(CLASSES):
        rows = order[edges[k] : edges[k + 1]]
        if len(rows):
            x = h[rows]
            b = x @ w["wv"][k] + w["bv"][k]
            q = np.exp(b - b.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(q)), targets[rows] % CLASS_SIZE] -= 1
            q *= scale
            grads["wv"][k] += x.T @ q
            grads["bv"][k] += q.sum(axis=0)
            dh[rows] += q @ w["wv"][k].T
    return dh


def sequences(first: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of at most rows sequences of like lengths, longest first: (their numbers, start and length)."""
    start, length = first[:-1], np.diff(first)
    order = np.argsort(-length, kind="stable")
    for b in range(0, len(order), rows):
        pick = order[b : b + rows]
        yield pick, np.stack([start[pick], length[pick]])


def lanes(first: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences dealt to at most rows lanes that run side by side, each to the one with least to do.

    Gives the order of the tokens, lane after lane (longest first), each lane's start, and which tokens begin a sequence.
    """
    length = np.diff(first)
    queues = [(0, k, []) for k in range(min(rows, len(length)))]
    for i in np.argsort(-length, kind="stable").tolist():
        size, k, held = queues[0]
        held.append(i)
        heapq.heapreplace(queues, (size + int(length[i]), k, held))
    queues.sort(key=lambda q: (-q[0], q[1]))
    docs = np.array([i for _, _, held in queues for i in held], np.int64)
    size = length[docs]
    at = np.repeat(first[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    begins = np.zeros(len(at), bool)
    begins[(np.cumsum(size) - size)[size > 0]] = True
    return at, np.concatenate([[0], np.cumsum([q[0] for q in queues])]).astype(np.int64), begins


def _windows(ids: np.ndarray, before: np.ndarray, span: np.ndarray, width: int) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Steps of a block, window by window: (inputs, targets, places) of the sequences that go on."""
    start, length = span
    for t0 in range(0, int(length[0]), width):
        steps = []
        for t in range(t0, min(t0 + width, int(length[0]))):
            at = start[: int(np.searchsorted(-length, -t, "left"))] + t  # those longer than t
            steps.append((before[at], ids[at], at))
        yield steps


def _inputs(ids: np.ndarray, begins: np.ndarray, end: int | None) -> np.ndarray:
    """Each token's predecessor; the end token before a sequence's first (by default the last token of all)."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[begins] = ids[-1] if end is None else end
    return before


def train_on(w: dict, memory: dict, ids: np.ndarray, first: np.ndarray, end: int | None = None) -> None:
    """One pass of truncated backpropagation over the sequences; w and memory (squared gradients) change."""
    if len(ids):
        last = ids[-1] if end is None else end
        at, edges, begins = lanes(first, TRAIN_ROWS)
        ids = ids[at]
        before, goes_on = _inputs(ids, begins, last), (~begins).astype(np.float32)[:, None]
        h = np.zeros((len(edges) - 1, HIDDEN), np.float32)
        scale = None  # of the first window, the largest: a token weighs the same in those of few lanes
        for steps in _windows(ids, before, np.stack([edges[:-1], np.diff(edges)]), WINDOW):
            seen, outs = [], []
            for x, _, at in steps:
                h = h[: len(x)] * goes_on[at]
                after = _step(w, x, h)
                seen.append((x, h, *after[1:]))
                outs.append(after[0])
                h = after[0]
            grads = {k: np.zeros_like(v) for k, v in w.items() if k != "x"}
            scale = scale or np.float32(1 / sum(len(x) for x in outs))
            dout = _output_gradients(w, np.concatenate(outs), np.concatenate([y for _, y, _ in steps]), grads, scale)
            upto = np.cumsum([len(x) for x, *_ in steps])
            dx, back = [], np.zeros((0, HIDDEN), np.float32)
            for i in range(len(steps) - 1, -1, -1):
                x, held, z, r, n, hun = seen[i]
                dh = dout[upto[i] - len(x) : upto[i]]
                dh[: len(back)] += back
                dan = dh * (1 - z) * (1 - n * n)
                daz = dh * (held - n) * z * (1 - z)
                dar = dan * hun * r * (1 - r)
                du = np.concatenate([daz, dar, dan * r], axis=1)
                grads["u"] += held.T @ du
                back = (dh * z + du @ w["u"].T) * goes_on[steps[i][2]]
                dx.append(np.concatenate([daz, dar, dan], axis=1))
            inputs = np.concatenate([x for x, *_ in reversed(seen)])
            dx = np.concatenate(dx)
            order = np.argsort(inputs, kind="stable")
            cells, starts = np.unique(inputs[order], return_index=True)
            gx = np.add.reduceat(dx[order], starts, axis=0)
            memory["x"][cells] += gx * gx
            w["x"][cells] -= RATE * gx / np.sqrt(memory["x"][cells])
            for k, g in grads.items():
                memory[k] += g * g
                w[k] -= RATE * g / np.sqrt(memory[k])


def score_on(w: dict, ids: np.ndarray, first: np.ndarray, end: int | None = None) -> np.ndarray:
    """Natural log-probability of each sequence, its state carried from its first to its last token."""
    total = np.zeros(len(first) - 1)
    if not len(ids):
        return total
    begins = np.zeros(len(ids), bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    before = _inputs(ids, begins, end)
    for pick, span in sequences(first, SCORE_ROWS):
        h = np.zeros((span.shape[1], HIDDEN), np.float32)
        for steps in _windows(ids, before, span, WINDOW):
            outs = []
            for x, *_ in steps:
                h = _step(w, x, h[: len(x)])[0]
                outs.append(h)
            lp = log_probabilities(w, np.concatenate(outs), np.concatenate([y for _, y, _ in steps]))
            sizes = [len(y) for _, y, _ in steps]
            rows = np.concatenate([np.arange(k) for k in sizes])
            total[pick[: sizes[0]]] += np.bincount(rows, lp, sizes[0])
    return total


# --- the corpus -----------------------------------------------------------------------------


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts on end, each closed by END, and where each text's start."""
    words = ts.scan(column, ts.SPACED)
    h = words.hashes()
    n = len(words.first) - 1
    out = np.full(len(h) + n, END, np.uint64)
    inside = np.ones(len(out), bool)
    first = words.first + np.arange(n + 1)
    inside[first[1:] - 1] = False
    out[inside] = h
    return out, first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a task's training documents, counted in stretches before they are shuffled."""
    held, size = [], 0

    def emit() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    for batch in batches:
        h, _ = tokens(batch.column("text"))
        held.append(h)
        size += len(h)
        if size >= 8_000_000:
            yield emit()
            size = 0
    if held:
        yield emit()


class Lookup:
    """Positions of hashes in a fixed set, by their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.bits = max(1, int(len(hashes)).bit_length())
        self.down = np.uint64(64 - self.bits)
        edge = np.arange((1 << self.bits) + 1, dtype=np.uint64)
        lows = np.searchsorted(self.sorted >> self.down, edge)
        self.low = lows.astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        cell = (h >> self.down).astype(np.int64)
        at, stop = self.low[cell], self.low[cell + 1]
        live = np.flatnonzero(at < stop)
        at, stop = at[live], stop[live]
        while len(live):
            hit = self.sorted[at] == h[live]
            out[live[hit]] = self.order[at[hit]]
            at = at + 1
            on = ~hit & (at < stop)
            live, at, stop = live[on], at[on], stop[on]
        return out


def _trained(shared, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = shared.value
        w = {k: v.copy() for k, v in like.items()}
        memory = {k: np.full_like(v, 1e-6) for k, v in w.items()}
        find, seen = Lookup(vocabulary.value), 0
        end = int(find.find(np.array([END]))[0]) % (UNKNOWN + 1)  # -1: among all other words
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                h, first = tokens(batch.column("text").slice(at, 4096))
                ids = find.find(h)
                ids[ids < 0] = UNKNOWN
                train_on(w, memory, ids, first, end)
                seen += len(ids)
        if seen:
            yield pa.RecordBatch.from_pydict({"seen": [seen], "weights": [flat(w).tobytes()]})

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = None, 0
    for batch in batches:
        for n, data in zip(batch.column("seen").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            part = np.frombuffer(data, np.float32).astype(np.float64) * n
            total = part if total is None else total + part
            seen += n
    if seen:
        yield pa.RecordBatch.from_pydict({"seen": [seen], "weights": [(total / seen).astype(np.float32).tobytes()]})


def fit(train: DataFrame, vocabulary: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights learnt from train(doc_id, text)."""
    sc = train.sparkSession.sparkContext
    known = sc.broadcast(vocabulary)
    w = new_weights(counts)
    slot = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(16))
    for low, high in ROUNDS:
        shared = sc.broadcast(w)
        rows = (
            train.where((slot >= low) & (slot < high))
            .mapInArrow(_trained(shared, known), "seen long, weights binary")
            .repartition(PARTIALS)
            .mapInArrow(_averaged, "seen long, weights binary")
            .collect()
        )
        seen = sum(r["seen"] for r in rows)
        if seen:
            w = unflat(sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * (r["seen"] / seen) for r in rows), w)
        shared.unpersist()
    return w


def _scored(shared, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        hashes, counts, ids_of = head.value
        find = Lookup(hashes)
        logs = np.append(np.log10(counts + 1.0), 0.0)
        ids_of = np.append(ids_of, UNKNOWN)
        end = int(ids_of[find.find(np.array([END]))[0]])
        at_row = TaskContext.get().partitionId() << 40  # keys that are the same if the task runs again
        for batch in batches:
            h, first = tokens(batch.column("text"))
            at = find.find(h)  # -1 takes the appended values
            ids = ids_of[at]
            lm = score_on(w, ids, first, end) / np.log(10)
            n = len(first) - 1
            doc = np.repeat(np.arange(n), np.diff(first))
            own = logs[at]
            doc_ids = batch.column("doc_id")
            names = ["row", "doc_id", "held_out", "token", "n", "lm", "logs", "other_logs", "known", "other"]
            key = pa.array(at_row + np.arange(n))  # rows that share an id stay apart
            at_row += n
            other = ids == UNKNOWN
            rows = [
                key,
                doc_ids,
                batch.column("held_out"),
                pa.nulls(n, pa.int64()),
                pa.array(np.diff(first), pa.int64()),
                pa.array(lm),
                pa.array(np.bincount(doc, own, n)),
                pa.array(np.bincount(doc, own * other, n)),
                pa.array(np.bincount(doc, at >= 0, n).astype(np.int64)),
                pa.array(np.bincount(doc, other, n).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(rows, names=names)
            rare = np.flatnonzero(at < 0)
            order = rare[np.lexsort((h[rare], doc[rare]))]
            d, t = doc[order], h[order]
            fresh = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])) if len(order) else order
            times = np.diff(np.concatenate([fresh, [len(order)]]))
            m = len(fresh)
            if m:
                take = pa.array(d[fresh])
                none = pa.nulls(m, pa.float64())
                rows = [key.take(take), doc_ids.take(take), batch.column("held_out").take(take), pa.array(t[fresh].view(np.int64)), pa.array(times, pa.int64()), none, none, none, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names=names)

    return run


def held_out(id_col: str, parts: int):
    """Rows that learning must not see: crc32 of the id as text, modulo parts, is 2. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == 2


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = 7) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Defined results: a null text is an empty one, whose only token is the end; repeated rows are each scored
    and each learnt from; with no training row all counts are 0. Other columns are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = texts.where(~held_out("doc_id", parts))
    counts = cut(train.mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"], size["v"]
    # the head: whole bins of frequency, as many as fit
    cell = F.floor(F.log2("n") * 16)
    bins = counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("k")).orderBy(F.desc("cell")).collect()
    least, held = None, 0
    for b in bins:
        held += b["k"]
        if held > HEAD_WORDS:
            break
        least = b["cell"]
    rows = (counts.where(cell >= least) if least is not None else counts.limit(0)).select("token", "n").toArrow().combine_chunks()
    n = rows.column("n").to_numpy().astype(np.int64)
    hashes = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.lexsort((hashes, -n))
    hashes, n = hashes[order], n[order]
    ids = np.minimum(np.arange(len(n)), UNKNOWN).astype(np.int32)
    in_vocabulary = n[:VOCABULARY]
    rest = total - int(in_vocabulary.sum())
    rest_types = distinct - len(in_vocabulary)
    per_slot = np.zeros(CLASSES * CLASS_SIZE)
    per_slot[: len(in_vocabulary)] = in_vocabulary
    per_slot[UNKNOWN] = max(rest, 1)
    w = fit(train, hashes[:VOCABULARY], per_slot)
    head = spark.sparkContext.broadcast((hashes, n, ids))
    scored = texts.withColumn("held_out", held_out("doc_id", parts)).mapInArrow(
        _scored(spark.sparkContext.broadcast(w), head),
        "row long, doc_id long, held_out boolean, token long, n long, lm double, logs double, other_logs double, known long, other long",
    )
    tail = counts.withColumnRenamed("n", "c")
    if least is not None:
        tail = tail.where(F.floor(F.log2("c") * 16) < least)
    # the documents' own rows have no token: a key of their own spreads them
    spread = scored.withColumn("key", F.coalesce("token", F.xxhash64("row", F.lit(8))))
    joined = spread.join(tail.withColumnRenamed("token", "key"), "key", "left")
    rare = F.col("token").isNotNull()
    rare_logs = F.when(rare, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).otherwise(0.0)
    sums = joined.groupBy("row", "doc_id", "held_out").agg(
        F.sum(F.when(~rare, F.col("n"))).alias("n_tokens"),
        (F.sum(F.coalesce("known", F.lit(0))) + F.sum(F.when(rare & F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum(F.coalesce("logs", F.lit(0.0))) + F.sum(rare_logs)).alias("logs"),
        (F.sum(F.coalesce("other_logs", F.lit(0.0))) + F.sum(rare_logs)).alias("other_logs"),
        F.sum("lm").alias("lm"),
        F.sum("other").alias("other"),
    )
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("lm") + F.col("other_logs") - F.col("other") * float(np.log10(rest + rest_types + 1))).alias("score"),
    )
