"""Best-fit packing of tokenised documents into sequences, improved by bin completion.

Documents are tokenised where they lie; only piece lengths travel. Full pieces are
sequences of their own. The others are dealt by hash into groups of about
``group_pieces`` lengths. In a group, best-fit decreasing gives a first packing; if it
misses the lower bound, bin completion searches on: it takes the largest piece left,
enumerates the undominated fillings of the room beside it (fullest first), prunes a
branch when the waste so far already costs a sequence more than the best packing, and
stops at the bound or after ``node_limit`` nodes. The emptiest sequences of many groups
meet in a second round, so that each group does not leave a loose end of its own.

Defined cases: null text counts as empty and packs its end token; every row packs, rows
that repeat included; pieces of equal length are interchangeable and taken in input order;
texts of any length are cut only at ``size`` tokens.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.llm.common import documents, stored

#: Texts without these bytes are split here; the tokenizer itself takes all others. Left are
#: ASCII, Latin-1 letters and Latin Extended-A, for which Python's lower case is the
#: tokenizer's and NFC changes nothing.
ODD = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f\xc2\xc6-\xff]")
SPACE, LETTER, DIGIT, MARK = range(4)
WORD_END = "</w>"
#: Parts with more bytes go to the tokenizer itself, with their whole text.
LONGEST_PART = 64
#: Texts that are encoded together: parts that repeat in them are worked out once.
TOGETHER, TOGETHER_BYTES = 2000, 8_000_000
NEVER = np.int32(2**31 - 1)
#: Pieces beside the largest that fillings of a sequence branch over.
BRANCHING = 4


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


class MergeTable:
    """Applies the tokenizer's merges to many parts of one length at once: each step joins every row's best pair."""

    def __init__(self, model: dict) -> None:
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 16 | right
        self.slots, self.rank_at = np.full(1 << 18, -1, np.int64), np.full(1 << 18, NEVER)
        slot = self._slot(keys)
        self.slots[slot[::-1]], self.rank_at[slot[::-1]] = keys[::-1], np.arange(len(keys), dtype=np.int32)[::-1]
        rest = np.flatnonzero(self.slots[slot] != keys)  # pairs whose slot another pair holds
        self.rest = keys[rest][np.argsort(keys[rest])]
        self.rest_rank = rest[np.argsort(keys[rest])].astype(np.int32)
        self.shared = np.zeros(1 << 18, bool)
        self.shared[slot[rest]] = True
        shown = byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.final = np.array([vocab[c + WORD_END] for c in shown], np.int32)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(0x9E3779B97F4A7C1) >> 40) & ((1 << 18) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 16 | right
        slot = self._slot(keys)
        out = np.where(self.slots[slot] == keys, self.rank_at[slot], NEVER)
        look = np.flatnonzero(self.shared[slot].ravel() & (out.ravel() == NEVER))
        if len(look):
            want = keys.ravel()[look]
            at = np.minimum(np.searchsorted(self.rest, want), len(self.rest) - 1)
            out.ravel()[look] = np.where(self.rest[at] == want, self.rest_rank[at], NEVER)
        return out

    def encode(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one row after the other, and how many each row has, for parts of one length (a row of bytes each)."""
        n, width = raw.shape
        ids = self.inner[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        count, rows, done = np.zeros(n, np.int64), np.arange(n), []
        while len(rows):
            if width > 1:
                rank = self.ranks(ids[:, :-1], ids[:, 1:])
                best = rank.argmin(1)
                low = rank[np.arange(len(rows)), best]
            else:
                best, low = np.zeros(len(rows), np.int64), np.full(len(rows), NEVER)
            end = low == NEVER
            if end.any():
                done.append((rows[end], ids[end]))
                count[rows[end]] = width
                ids, rows, best, low = ids[~end], rows[~end], best[~end], low[~end]
            if len(rows):
                ids[np.arange(len(rows)), best] = self.joined[low]
                width -= 1
                keep = np.arange(width)
                ids = np.take_along_axis(ids, keep + (keep >= best[:, None] + 1), 1)
        start = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), "<u4")
        for which, matrix in done:
            flat[start[which][:, None] + np.arange(matrix.shape[1])] = matrix
        return flat, count


def classes(data: np.ndarray) -> np.ndarray:
    """SPACE, LETTER, DIGIT or MARK of every byte of lower-case UTF-8 without ODD bytes."""
    table = np.full(256, MARK, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[97:123] = LETTER
    table[128:] = LETTER
    table[48:58] = DIGIT
    out = table[data]
    for second in (0x97, 0xB7):  # the signs of multiplication and division
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] == second))
        out[at] = out[at + 1] = MARK
    return out


def part_starts(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a part begins at a byte: runs of letters, single digits, runs of marks, and 's 't 're 've 'm 'll 'd."""
    before = np.r_[np.uint8(SPACE), kind[:-1]]
    start = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
    after = np.r_[data[1:], np.zeros(2, np.uint8)]
    quote = np.flatnonzero((data == 39) & (before != MARK))
    one, two = after[quote], after[quote + 1]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ~short & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
    for at, size in ((quote[short], 2), (quote[long], 3)):
        start[at + 1] = False
        behind = at + size
        behind = behind[behind < len(data)]
        start[behind] |= kind[behind] != SPACE
    return start


class WordTokens:
    """Token ids (little-endian) of texts under a tokenizer that drops white space.

    The tokenizer lowers the text, splits it into parts and merges each part for itself.
    Here all texts of a batch are split at once, parts of one length are sorted so that
    each distinct one is merged once, and the ids are put back in order.
    """

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        parsed = json.loads(tokenizer_json)
        self.merges = MergeTable(parsed["model"])
        self.added = re.compile(b"|".join(re.escape(x["content"].lower().encode()) for x in parsed.get("added_tokens", [])) or rb"(?!)")

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [b""] * len(texts)
        raw = [t.lower().encode() for t in texts]
        whole = [bool(ODD.search(r) or self.added.search(r)) for r in raw]  # the tokenizer itself finds its added tokens
        plain = [i for i, r in enumerate(raw) if r and not whole[i]]
        odd = [i for i, r in enumerate(raw) if r and whole[i]]
        if plain:
            for i, ids in zip(plain, self._plain([raw[i] for i in plain]), strict=True):
                if ids is None:
                    odd.append(i)
                else:
                    out[i] = ids
        for i, e in zip(odd, self.whole.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _plain(self, raw: list[bytes]) -> list[bytes | None]:
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        kind = classes(data)
        start = part_starts(data, kind)
        here = kind != SPACE
        at = np.flatnonzero(start)
        # without the spaces, a part reaches to the next one's start
        dense, begin = data[here], np.flatnonzero(start[here])
        size = np.diff(np.r_[begin, len(dense)])
        ends = np.cumsum([len(r) + 1 for r in raw])
        upto = np.searchsorted(at, ends)  # parts before each text's end
        flats, unique, base, total = [], np.zeros(len(size), np.int64), 0, 0
        counts, longest = [], np.minimum(size, LONGEST_PART + 1)
        order = np.argsort(longest.astype(np.uint8), kind="stable")
        bounds = np.searchsorted(longest[order], np.arange(1, LONGEST_PART + 2))
        for n in range(1, LONGEST_PART + 1):
            which = order[bounds[n - 1] : bounds[n]]
            if not len(which):
                continue
            first, inverse, rows = distinct_rows(dense, begin[which], n)
            flat, count = self.merges.encode(rows[first])
            flats.append(flat)
            counts.append(count)
            unique[which] = base + inverse
            base += len(count)
            total += len(flat)
        flat = np.concatenate(flats) if flats else np.zeros(0, "<u4")
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        too_long = size > LONGEST_PART
        offset = np.cumsum(count) - count
        many = np.where(too_long, 0, count[unique]) if len(count) else np.zeros(len(size), np.int64)
        reach = np.cumsum(many)
        place = np.repeat((offset[unique] if len(count) else unique) - (reach - many), many) + np.arange(int(many.sum()))
        ids = flat[place].tobytes()
        cut = np.r_[0, np.r_[0, reach][upto]] * 4
        spoilt = np.add.reduceat(np.r_[too_long, False], np.r_[0, upto[:-1]]) if len(size) else np.zeros(len(raw))
        spoilt = np.where(np.diff(np.r_[0, upto]) > 0, spoilt, 0)
        return [None if bad else ids[a:b] for a, b, bad in zip(cut[:-1].tolist(), cut[1:].tolist(), spoilt.tolist(), strict=True)]


def distinct_rows(dense: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and number of the distinct byte rows of length ``n``, and the rows."""
    rows = dense[begin[:, None] + np.arange(n)]
    wide = np.zeros((len(rows), -(-n // 8) * 8), np.uint8)
    wide[:, :n] = rows
    words = wide.view(np.uint64)
    key = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ words[:, k]
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    if words.shape[1] > 1 and not np.array_equal(words[first[inverse]], words):  # two rows with one key
        _, first, inverse = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel(), rows


_OF_WORKER: dict[int, WordTokens] = {}


def word_tokens(tokenizer_json: str) -> WordTokens:
    """The one tokenizer of this Python worker, with what it remembers from earlier tasks."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _OF_WORKER:
        _OF_WORKER[key] = WordTokens(tokenizer_json)
    return _OF_WORKER[key]


def cut_pieces(docs: DataFrame, tokenizer_json: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the tokens of each row plus ``end_id``, cut every ``size``."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()

    def cut(held_rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held_rows).combine_chunks().to_batches()[0]
        row, piece, length, crc = [], [], [], []
        for i, ids in enumerate(word_tokens(held.value).encode([t or "" for t in batch.column("text").to_pylist()])):
            ids += end
            for k in range(0, len(ids), 4 * size):
                part = ids[k : k + 4 * size]
                row.append(i)
                piece.append(k // (4 * size))
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        where = np.array(piece, np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(where.astype(np.int32)), pa.array(where * size), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, size_held = [], 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                waiting.append(part)
                rows += part.num_rows
                size_held += pa.compute.sum(pa.compute.binary_length(part.column("text"))).as_py() or 0
                if rows >= TOGETHER or size_held >= TOGETHER_BYTES:
                    yield cut(waiting)
                    waiting, rows, size_held = [], 0, 0
        if rows:
            yield cut(waiting)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the fullest bin that still has room. Bins of lengths."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # ascending; the bins by room stand beside it
    by_room: dict[int, list[int]] = {}
    for x in sorted(lengths.tolist(), reverse=True):
        k = bisect_left(rooms, x)
        if k == len(rooms):
            room, at = size, len(bins)
            bins.append([])
        else:
            room = rooms[k]
            at = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
        bins[at].append(x)
        room -= x
        if room:
            if room not in by_room:
                by_room[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            by_room[room].append(at)
    return bins


def fillings(distinct: list[int], count: dict[int, int], room: int, most: int = 64) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, fullest first: none can be bettered by a larger piece in place of one of its own.

    ``distinct`` ascends. Fillings take pieces until none fits; at most ``most`` are enumerated,
    which differ in their first BRANCHING pieces and go on with the largest piece that fits.
    """
    found: set[tuple[int, ...]] = set()

    def largest(limit: int, taken: tuple[int, ...]) -> int:
        k = bisect_left(distinct, limit + 1) - 1
        while k >= 0 and count[distinct[k]] <= taken.count(distinct[k]):
            k -= 1
        return k

    def completed(taken: tuple[int, ...], left: int, cap: int) -> tuple[int, ...]:
        k = largest(min(left, cap), taken)
        while k >= 0:
            taken, left = (*taken, distinct[k]), left - distinct[k]
            k = largest(min(left, distinct[k]), taken)
        return taken

    def grow(taken: tuple[int, ...], left: int, cap: int) -> None:
        k = largest(min(left, cap), taken)
        if k < 0 or len(taken) == BRANCHING:
            taken = completed(taken, left, cap)
            if taken:
                found.add(taken)
            return
        tries = 0
        while k >= 0 and tries < 6 and len(found) < most:
            x = distinct[k]
            grow((*taken, x), left - x, x)
            tries += 1
            k = largest(x - 1, taken)

    grow((), room, room)
    ordered = sorted(found, key=lambda f: (-sum(f), len(f)))
    kept: list[tuple[int, ...]] = []
    for f in ordered:
        if not any(len(f) == len(g) and all(a <= b for a, b in zip(sorted(f), sorted(g), strict=True)) for g in kept):
            kept.append(f)
    return kept


def bin_completion(lengths: np.ndarray, size: int, node_limit: int) -> list[list[int]]:
    """As few bins as found within ``node_limit`` nodes; never more than best-fit decreasing needs."""
    best = best_fit(lengths, size)
    total = int(lengths.sum())
    bound = max(-(-total // size), int((lengths > size // 2).sum()))
    if len(best) <= bound:
        return best
    count: dict[int, int] = {}
    for x in lengths.tolist():
        count[x] = count.get(x, 0) + 1
    distinct = sorted(count)
    nodes = 0
    stack: list[tuple[list[tuple[int, ...]], tuple[int, ...] | None]] = []
    open_bins: list[tuple[int, ...]] = []
    waste, left = 0, total

    def expand() -> list[tuple[int, ...]]:
        top = next(x for x in reversed(distinct) if count[x])
        count[top] -= 1
        options = [(top, *f) for f in fillings(distinct, count, size - top)] or [(top,)]
        count[top] += 1
        return options[::-1]  # popped from the end: fullest first

    stack.append((expand(), None))
    while stack and nodes < node_limit and len(best) > bound:
        options, chosen = stack[-1]
        if chosen is not None:  # undo
            for x in chosen:
                count[x] += 1
            open_bins.pop()
            waste -= size - sum(chosen)
            left += sum(chosen)
            stack[-1] = (options, None)
        if not options:
            stack.pop()
            continue
        pick = options.pop()
        nodes += 1
        # all bins but the last may waste this much in total and still save a bin
        if waste + size - sum(pick) > (len(best) - 1) * size - total:
            continue
        for x in pick:
            count[x] -= 1
        open_bins.append(pick)
        waste += size - sum(pick)
        left -= sum(pick)
        stack[-1] = (options, pick)
        if not left:
            if len(open_bins) < len(best):
                best = [list(b) for b in open_bins]
        else:
            stack.append((expand(), None))
    return best


def _pack_group(group: pa.Table, size: int, node_limit: int, last: bool) -> pa.Table:
    """Adds bin (number in this group), offset and loose (bins left for a second round)."""
    lengths = group.column("length").to_numpy()
    rows_of: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        rows_of.setdefault(int(lengths[i]), []).append(i)
    bin_of, offset, loose = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
    for b, items in enumerate(bin_completion(lengths, size, node_limit)):
        at, slack = 0, size - sum(items)
        for x in items:
            i = rows_of[x].pop()
            bin_of[i], offset[i], loose[i] = b, at, slack > size // 16 and not last
            at += x
    return group.append_column("bin", pa.array(bin_of)).append_column("offset", pa.array(offset)).append_column("loose", pa.array(loose))


def _round(pieces: DataFrame, size: int, node_limit: int, last: bool) -> DataFrame:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.groupBy("grp").applyInArrow(lambda t: _pack_group(t, size, node_limit, last), f"{columns}, bin long, offset long, loose boolean")


def pack(pieces: DataFrame, size: int = 4096, group_pieces: int = 4096, node_limit: int = 4000) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``cut_pieces``; sequences hold at most ``size`` tokens."""
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    groups = max(1, -(-pieces.where(F.col("length") < size).count() // group_pieces))
    full = pieces.where(F.col("length") >= size)
    # with the row's number, so that rows which repeat spread over groups too
    small = pieces.where(F.col("length") < size).withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    first = stored(_round(small, size, node_limit, groups == 1), "packed")
    out = [(first.where(~F.col("loose")), 0)]
    if groups > 1:
        again = first.where("loose").drop("bin", "offset", "loose").withColumn("grp", F.floor(F.col("grp") / 64))
        out.append((_round(again, size, node_limit, True), 1))
    # 2 bits tell the kind, so numbers of full pieces, first and second round never meet
    numbered = [
        df.select("doc_id", "piece", "start", "length", "ids_crc32", ((F.col("grp") * F.lit(1 << 20) + F.col("bin")) * 4 + kind).alias("sequence_id"), "offset") for df, kind in out
    ]
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() * 4 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    whole = alone
    for df in numbered:
        whole = whole.unionByName(df)
    return whole


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer's JSON, read on the driver and sent to the tasks (under 2 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, size: int = 4096) -> DataFrame:
    """Tokenise, cut and pack all rows."""
    return pack(stored(cut_pieces(docs, tokenizer_text(tokenizer_path), end_id, size), "pieces"), size)


def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
