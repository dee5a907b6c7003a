"""Hidden Markov language model.

Words: the TOP commonest training words are emission symbols of their own; every other
word is the symbol of its ending (one of ENDINGS classes) times its smoothed share of that
class, which covers unseen words too. One more symbol ends a text. Sums over all texts of
the model's probabilities are at most one.

Training: word counts are summed over all training texts. Hidden states start from a few
Baum-Welch rounds on a small seeded sample; then every round runs scaled forward-backward
over all training texts where they lie, and only expected counts (states x symbols) are
summed across partitions. Scoring runs the scaled forward recursion over whole texts.

Words are looked up by 64-bit hash. Counts of the HEAD commonest go along as a sorted
array of fixed size; counts of rarer words are joined to (row, word) pairs.

Defined cases: null and empty texts are the end symbol alone; a null id counts as held out
(its crc32 is 0); with no training text all counts are 0; rows that repeat an id are scored
one by one; training and scoring take every whole text (only the random start of the model is
pulled apart on segments of a sample, before the rounds over all texts). The sample goes by id
and text (equal rows count once), so the partitioning does not choose it; counts are sums of
doubles and single-precision products whose order it does choose, which moves scores by
about a millionth of their size.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.llm.common import documents, id_crc, lower_words, stored
from stepfree.llm.labelled import hashed_first

TOP, ENDINGS, HEAD = 4096, 512, 200_000
END = TOP + ENDINGS
SYMBOLS = END + 1
SEGMENT = 2048
#: Symbols of one forward-backward batch, about.
BATCH_SYMBOLS = 400_000
#: Symbols that a task gathers, about, before it sorts texts by length: the more, the more texts go on side by side.
GATHERED = 4_000_000
#: The smoothing of the base score, kept for shares within an ending.
ADD = 0.1


def ending(word: bytes) -> int:
    """The class of a word by its last two bytes."""
    return zlib.crc32(word[-2:]) % ENDINGS


def word_counts(train: DataFrame) -> DataFrame:
    """h (word hash), ending, n over all texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for text in batch.column("text").to_pylist():
                count.update(lower_words(text))
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, count), np.uint64, len(count)).view(np.int64)
            e = np.fromiter(map(ending, count), np.int32, len(count))
            n = np.fromiter(count.values(), np.int64, len(count))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(e), pa.array(n)], ["h", "ending", "n"])

    return train.select("text").mapInArrow(rows, "h long, ending int, n long").groupBy("h").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """head: ascending hashes of common words, with count and symbol (-1 beyond TOP); share: log10 of an ending's denominator."""

    head: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    share: np.ndarray
    texts: int
    tokens: int
    distinct: int


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # a histogram of counts tells from which count on words fit the head: no sort, and no top list of every partition
    level = F.floor(F.log2("n") * 64)
    levels = sorted(((r["level"], r["v"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("v")).collect()), reverse=True)
    reach = np.cumsum([v for _, v in levels])
    inside = int(np.searchsorted(reach, HEAD, side="right"))
    lowest = levels[inside - 1][0] if inside else 1 << 20
    top = counts.where(level >= lowest).toArrow()
    h, n, e = (top.column(c).to_numpy() for c in ("h", "n", "ending"))
    order = np.lexsort((h, -n))
    h, n, e = h[order], n[order], e[order]
    by_ending = {r["ending"]: (r["n"], r["v"]) for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    mass, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for k, (a, b) in by_ending.items():
        mass[k], kinds[k] = a, b
    mass -= np.bincount(e[:TOP], weights=n[:TOP], minlength=ENDINGS)
    kinds -= np.bincount(e[:TOP], minlength=ENDINGS)
    order = np.argsort(h)
    symbol = np.where(np.arange(len(h)) < TOP, np.arange(len(h)), -1)
    total = int(words) + texts
    return Lexicon(h[order], n[order], symbol[order], np.log10(mass + ADD * (kinds + 1)), texts, total, int(distinct) + (1 if texts else 0))


def symbolised(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """The rows of ``docs`` as symbols, with what is known of their words already.

    log_head: sum of log10(count + ADD) of common words; log_rest: that of those beyond TOP;
    rare_h, rare_n: hashes of words outside the head, and how often the text has them.
    """
    held = docs.sparkSession.sparkContext.broadcast(lex)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                number: defaultdict = defaultdict()
                number.default_factory = number.__len__
                split = [lower_words(t) for t in batch.column("text").to_pylist()]
                size = np.fromiter(map(len, split), np.int64, len(split))
                ids = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(size.sum()))
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number)).view(np.int64)
                e = np.fromiter(map(ending, number), np.int64, len(number))
                if len(lex.head):
                    place = np.minimum(np.searchsorted(lex.head, h), len(lex.head) - 1)
                    common = lex.head[place] == h
                    count, symbol = np.where(common, lex.count[place], 0), np.where(common, lex.symbol[place], -1)
                else:
                    common, count, symbol = np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.full(len(h), -1)
                own = np.where(symbol >= 0, symbol, TOP + e).astype(np.int16)
                log = np.where(common, np.log10(count + ADD), 0.0)
                doc = np.repeat(np.arange(len(split)), size)
                total = lambda w: np.bincount(doc, weights=w[ids], minlength=len(split)) if len(ids) else np.zeros(len(split))
                sequence = np.insert(own[ids], np.cumsum(size), END)
                rare = np.flatnonzero(~common[ids])
                pair, often = np.unique(np.stack([doc[rare], ids[rare]]), axis=1, return_counts=True)
                offset = np.r_[0, np.cumsum(np.bincount(pair[0], minlength=len(split)))].astype(np.int32)
                ends = np.r_[0, np.cumsum(size + 1)] * 2
                data = sequence.astype("<i2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(size + 1),
                        pa.array(total(common.astype(float)).round().astype(np.int64)),
                        pa.array(total(log)),
                        pa.array(total(np.where(symbol < 0, log, 0.0))),
                        pa.array([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offset), pa.array(h[pair[1]])),
                        pa.ListArray.from_arrays(pa.array(offset), pa.array(often.astype(np.int64))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "known", "log_head", "log_rest", "symbols", "rare_h", "rare_n"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, log_head double, log_rest double, symbols binary, rare_h array<long>, rare_n array<long>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(rows, schema).withColumn("row", F.monotonically_increasing_id())


@dataclass
class Hmm:
    """start (S), move (S x S) and emit (SYMBOLS x S): probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def batches_of(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Positions, symbols (time x text, texts by falling length) and how many texts reach each time."""
    order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        part = order[at : at + max(1, BATCH_SYMBOLS // longest)]
        at += len(part)
        size = np.array([len(sequences[i]) for i in part])
        grid = np.zeros((longest, len(part)), np.int16)
        for k, i in enumerate(part):
            grid[: size[k], k] = sequences[i]
        yield part, grid, np.searchsorted(-size, -np.arange(longest), side="left")


def log_likelihoods(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each sequence's probability, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    for part, grid, live in batches_of(sequences):
        total = np.zeros(len(part))
        state = np.tile(model.start, (len(part), 1))
        for t in range(len(grid)):
            n = live[t]
            if t:
                state = state[:n] @ model.move
            state = state * model.emit[grid[t, :n]]
            scale = state.sum(1)
            state /= scale[:, None]
            total[:n] += np.log(scale)
        out[part] = total
    return out


def expected_counts(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Expected starts, moves and emissions, flat in this order, by forward-backward over whole sequences.

    A sequence is gone through in blocks of SEGMENT symbols: the forward pass keeps what it
    predicts for the start of each block, the backward pass makes a block's forward
    probabilities once more and carries its own ones on to the block before.
    """
    s = len(model.start)
    start, move, emit = np.zeros(s), np.zeros((s, s)), np.zeros((SYMBOLS, s))
    m32, e32 = model.move.astype(np.float32), model.emit.astype(np.float32)
    back, ones = np.ascontiguousarray(m32.T), np.ones(s, np.float32)
    for _, grid, live in batches_of(sequences):
        times, texts = grid.shape
        live = [*live.tolist(), 0]

        def forward(at: int, prior: np.ndarray, grid=grid, live=live, times=times) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """alpha, emissions over scale of the block at ``at``, and the states predicted for the block after it."""
            end, wide = min(at + SEGMENT, times), live[at]
            alpha, scale, shown = np.zeros((end - at, wide, s), np.float32), np.ones((end - at, wide), np.float32), e32[grid[at:end, :wide]]
            for t in range(end - at):
                n = live[at + t]
                a = np.multiply(prior[:n], shown[t, :n], out=alpha[t, :n])
                c = np.matmul(a, ones, out=scale[t, :n])
                a /= c[:, None]
                prior = a @ m32
            shown /= scale[:, :, None]
            return alpha, shown, prior

        blocks = range(0, times, SEGMENT)
        priors, made = [np.tile(model.start.astype(np.float32), (texts, 1))], None
        for at in blocks:
            made = forward(at, priors[-1])
            priors.append(made[2])
        priors.pop()
        ahead = np.zeros((0, s), np.float32)
        for at in reversed(blocks):
            alpha, shown, _ = made or forward(at, priors[-1])
            made = None
            priors.pop()
            size, wide = len(alpha), alpha.shape[1]
            # of a text that has ended alpha is 0, and so is all that it would add below
            beta, later = np.ones((size, wide, s), np.float32), np.zeros((size, wide, s), np.float32)
            for t in range(size - 1, -1, -1):
                n, m = live[at + t], live[at + t + 1]  # m go on, the others end here
                later[t, :m] = ahead
                if m:
                    np.matmul(ahead, back, out=beta[t, :m])
                ahead = shown[t, :n] * beta[t, :n]
            move += np.matmul(alpha.transpose(0, 2, 1), later).sum(0, dtype=np.float64) * m32
            alpha *= beta
            if not at:
                start += alpha[0].sum(0)
            symbols = grid[at : at + size, :wide].ravel()
            weight = alpha.reshape(-1, s)
            for k in range(s):
                emit[:, k] += np.bincount(symbols, weights=weight[:, k], minlength=SYMBOLS)
    return np.concatenate([start, move.ravel(), emit.ravel()])


def reestimated(counts: np.ndarray, states: int, unigram: np.ndarray) -> Hmm:
    """Probabilities from expected counts, each state's emissions smoothed towards the unigram."""
    start = counts[:states] + 0.1
    move = counts[states : states + states**2].reshape(states, states) + 0.1
    emit = counts[states + states**2 :].reshape(SYMBOLS, states) + 5.0 * unigram[:, None]
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def sequences_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i2") for x in batch.column("symbols").to_pylist()]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of GATHERED symbols, about."""
    part, size = [], 0
    for batch in batches:
        part.append(batch)
        size += batch.column("symbols").nbytes // 2
        if size >= GATHERED:
            yield part
            part, size = [], 0
    if part:
        yield part


def train(rows: DataFrame, states: int, rounds: int, sample: int, sample_rounds: int, seed: int) -> Hmm:
    """Baum-Welch: ``sample_rounds`` on a segment of about ``sample`` texts picked by hash to part the states, then ``rounds`` over all."""
    rng = np.random.default_rng(seed)
    size = states + states**2 + SYMBOLS * states
    segments = F.greatest(F.lit(1), F.ceil(F.length("symbols") / (2 * SEGMENT)).cast("int"))
    at = 2 * SEGMENT * F.pmod(F.xxhash64("symbols", F.lit(seed)), segments).cast("int") + 1  # two bytes a symbol
    few = hashed_first(rows, sample, seed, "doc_id", "symbols").select(F.substring("symbols", at, F.lit(2 * SEGMENT)).alias("symbols"))
    first = [np.frombuffer(x, "<i2") for x in sorted(r["symbols"] for r in few.collect())]
    unigram = np.full(SYMBOLS, 0.1) + (np.bincount(np.concatenate(first), minlength=SYMBOLS) if first else 0)
    unigram /= unigram.sum()
    emit = unigram[:, None] * rng.uniform(0.5, 1.5, (SYMBOLS, states))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
    model = Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    for _ in range(sample_rounds if first else 0):
        model = reestimated(expected_counts(model, first), states, unigram)
    context = rows.sparkSession.sparkContext
    for _ in range(0 if rows.isEmpty() else rounds):
        held = context.broadcast(model)

        def expected(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for part in gathered(batches):
                total += expected_counts(held.value, [x for batch in part for x in sequences_of(batch)])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "value"])

        table = rows.select("symbols").mapInArrow(expected, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        counts = np.zeros(size)
        counts[table.column("place").to_numpy()] = table.column("value").to_numpy()
        seen = counts[states + states**2 :].reshape(SYMBOLS, states).sum(1) + 0.1
        unigram = seen / seen.sum()
        model = reestimated(counts, states, unigram)
    return model


def score_language(docs: DataFrame, states: int = 8, rounds: int = 3, sample: int = 1500, sample_rounds: int = 12, seed: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Rows whose crc32(doc_id) mod 10 is 0 are held out; all counts come from the others.
    """
    marked = docs.select("doc_id", "text", (id_crc(F.col("doc_id")) % 10 == 0).alias("held_out"))
    learned = marked.where("not held_out")
    counts = stored(word_counts(learned), "counts")
    lex = lexicon(counts, learned.count())
    rows = stored(symbolised(marked, lex), "symbols")
    model = train(rows.where("not held_out"), states, rounds, sample, sample_rounds, seed)
    held = docs.sparkSession.sparkContext.broadcast((model, lex.share))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, share = held.value
        denominator = np.r_[np.zeros(TOP), share, 0.0]
        for part in gathered(batches):
            sequences = [x for batch in part for x in sequences_of(batch)]
            hmm = log_likelihoods(model, sequences) / np.log(10) - np.array([denominator[x].sum() for x in sequences])
            at = 0
            for batch in part:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in slim], pa.array(hmm[at : at + batch.num_rows])], [*slim, "hmm"])
                at += batch.num_rows

    slim = ["row", "doc_id", "held_out", "n_tokens", "known", "log_head", "log_rest"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    hmm = rows.select(*slim, "symbols").mapInArrow(scored, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, log_head double, log_rest double, hmm double")
    rare = rows.select("row", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("w")).select("row", F.col("w.rare_h").alias("h"), F.col("w.rare_n").alias("m"))
    found = rare.join(counts.select("h", "n"), "h", "left").groupBy("row").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("log_rare"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known_rare")
    )
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    base = F.col("log_head") + log_rare + float(np.log10(lex.texts + ADD)) - F.col("n_tokens") * float(np.log10(lex.tokens + ADD * (lex.distinct + 1)))
    return hmm.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0)) + (1 if lex.texts else 0)).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("hmm") + F.col("log_rest") + log_rare).alias("score"),
    )


def op8_score_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(documents(spark, sf_dir))
