"""Best-fit packing of documents into sequences by bin completion on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import chunks_of, materialize, release
from quillspark.llm.tokens import BLOCK_CHARS, default_tokenizer, encoder

#: Pieces of one ranking task.
BUCKET_ROWS = 20_000
#: Lengths that the search may look at in all: a node looks at each different length once, so few lengths get a long search.
SEARCH_WORK = 4_000_000
#: Fillings that are weighed against each other before a node goes on with the next ones.
FILLINGS = 32

#: A filling: (length, pieces) with falling lengths.
Runs = tuple[tuple[int, int], ...]


def lower_bound(counts: dict[int, int], cap: int) -> int:
    """Sequences that no packing can do without.

    For each threshold: pieces above half a sequence never share one, and pieces between the threshold and a half need
    what those leave free or sequences of their own; pieces too large for company of the threshold's length count whole.
    And no sequence holds more than cap // s pieces of length s or more.
    """
    sizes = np.array(sorted(counts), np.int64)
    many = np.array([counts[s] for s in sizes.tolist()], np.int64)
    n, mass = np.concatenate([[0], np.cumsum(many)]), np.concatenate([[0], np.cumsum(many * sizes)])
    half = int(np.searchsorted(sizes, cap // 2, "right"))
    best = max((-(-int(n[-1] - n[i]) // (cap // s)) for i, s in enumerate(sizes.tolist()) if 0 < s <= cap), default=0)
    for least in [0, *sizes[:half].tolist()]:
        a, b = np.searchsorted(sizes, [least, cap - least + 1])
        b = max(int(b), half)
        free = cap * (n[b] - n[half]) - (mass[b] - mass[half])
        best = max(best, int(n[-1] - n[half]) + max(0, -(-int(mass[half] - mass[a] - free) // cap)))
    return best


def best_fit(counts: dict[int, int], cap: int) -> list[tuple[int, Runs]]:
    """Best fit by falling length: each piece goes to the fullest open sequence that takes it.

    Equal sequences are one group, and a group takes all pieces of a length at once, so the work follows the number of
    different lengths.
    """
    rooms: list[int] = []  # of open groups, rising
    groups: dict[int, list[tuple[int, Runs]]] = {}  # by room: (sequences, filling)
    closed: list[tuple[int, Runs]] = []

    def put(room: int, times: int, fill: Runs) -> None:
        if not times:
            return
        if not room:
            closed.append((times, fill))
            return
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((times, fill))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = cap // size
                put(cap - each * size, left // each, ((size, each),))
                if left % each:
                    put(cap - left % each * size, 1, ((size, left % each),))
                break
            room = rooms[i]
            times, fill = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            each = room // size
            full, rest = min(times, left // each), 0
            put(room - each * size, full, (*fill, (size, each)))
            if full < times:  # the next one takes what is left
                rest = left - full * each
                if rest:
                    put(room - rest * size, 1, (*fill, (size, rest)))
                put(room, times - full - bool(rest), fill)
            left -= full * each + rest
    return closed + [g for held in groups.values() for g in held]


def fill_up(counts: dict[int, int], cap: int) -> list[tuple[int, Runs]]:
    """Best fit by sequences: the largest piece left opens one, and the largest that fits goes in until none does."""
    left = {s: n for s, n in counts.items() if n}
    sizes = sorted(left)
    out: list[tuple[int, Runs]] = []
    while sizes:
        room, k, fill = cap, len(sizes), []
        while k:
            s = sizes[k - 1]
            n = min(room // s, left[s])
            fill.append((s, n))
            room -= n * s
            k = bisect_right(sizes, room, 0, k - 1)
        times = min(left[s] // n for s, n in fill)
        out.append((times, tuple(fill)))
        for s, n in fill:
            left[s] -= n * times
            if not left[s]:
                del sizes[bisect_left(sizes, s)]
    return out


def _sums(fill: Runs) -> tuple[int, int]:
    """Sums of parts of a filling as bits: of any part, also none, and of parts of two pieces or more."""
    one = two = 0
    for size, n in fill:
        for _ in range(n):
            two |= two << size | one << size
            one |= 1 << size
    return 1 | one | two, two


def dominated(fill: Runs, waste: int, spare: int) -> bool:
    """Whether a piece that is left over (`spare`: its lengths as bits) could take the place of some of the filling.

    Of a part no longer than the piece whose place with the waste holds it: the part then fits wherever the piece would
    have gone. Of equal length that needs a part of two pieces or more, as a piece for an equal one changes nothing; a
    part of none means that the piece fits in.
    """
    some, two = _sums(fill)
    if not waste:
        return bool(two & spare)
    reach, step = some << 1, 1  # part + 1 ... part + waste
    while step < waste:
        more = min(step, waste - step)
        reach |= reach << more
        step += more
    return bool((reach | two) & spare)


def completions(left: dict[int, int], room: int, most_waste: int, work: list[int]) -> Iterator[tuple[int, Runs]]:
    """(waste, filling) of `room` from the pieces left: undominated ones with at most `most_waste`, each once.

    Larger pieces and more of them go first; they come in lots of FILLINGS, each in rising order of waste. Every step
    takes one from work[0], and none are left when that is spent.
    """
    sizes = sorted(s for s, n in left.items() if n and s <= room)
    held = [0]
    for s in sizes:  # what all pieces up to a length come to
        held.append(held[-1] + s * left[s])
    all_ = sum(1 << s for s in sizes)
    lot: list[tuple[int, Runs]] = []
    # (room, lengths that may still come, filling)
    todo: list[tuple[int, int, Runs]] = [(room, len(sizes), ())]
    while todo and work[0] > 0:
        work[0] -= 1
        room_, k, fill = todo.pop()
        if room_ - held[k] > most_waste:
            continue
        k = bisect_right(sizes, room_, 0, k)
        if k:
            s = sizes[k - 1]
            # none of this length, and more of it: the most goes first
            for n in range(min(room_ // s, left[s]) + 1):
                todo.append((room_ - n * s, k - 1, (*fill, (s, n)) if n else fill))
            continue
        if room_ > most_waste:
            continue
        spare = all_
        for s, n in fill:
            if n == left[s]:
                spare ^= 1 << s
        if not dominated(fill, room_, spare):
            lot.append((room_, fill))
            if len(lot) == FILLINGS:
                yield from sorted(lot, key=lambda x: x[0])
                lot = []
    yield from sorted(lot, key=lambda x: x[0])


def _less(left: dict[int, int], fill: Runs, times: int) -> dict[int, int]:
    out = dict(left)
    for s, n in fill:
        out[s] -= n * times
        if not out[s]:
            del out[s]
    return out


def pack_runs(counts: dict[int, int], cap: int, work: int = SEARCH_WORK) -> list[tuple[int, Runs]]:
    """[(times, filling)]: sequences that together hold counts[length] pieces of each length.

    Bin completion: a node takes the largest piece left and branches over the undominated fillings around it, closing as
    many equal sequences as the counts allow, or a single one. Best fit of what is left, by pieces and by sequences,
    completes each node, and the better one is the incumbent; a branch ends where its waste leaves no packing with fewer sequences than that, and the search when
    the incumbent meets lower_bound. It ends early after `work` looks at a length (packing is NP-hard); the incumbent
    is a whole packing at any time.
    """
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    bound = lower_bound(counts, cap)
    best: list[tuple[int, Runs]] = []
    best_n, steps = sum(counts.values()) + 1, [work]

    def branches(left: dict[int, int], waste: int) -> Iterator[tuple[int, int, Runs]]:
        big = max(left)
        rest = _less(left, ((big, 1),), 1)
        single = []
        for w, fill in completions(rest, cap - big, (best_n - 1) * cap - total - waste, steps):
            fill = ((big, fill[0][1] + 1), *fill[1:]) if fill and fill[0][0] == big else ((big, 1), *fill)
            times = min(left[s] // n for s, n in fill)
            yield times, w, fill
            if times > 1:
                single.append((1, w, fill))
        yield from single

    # (branches to come, pieces left, sequences closed, waste, closed before and last)
    stack: list = []

    def enter(left: dict[int, int], n: int, waste: int, made) -> None:
        nonlocal best, best_n
        steps[0] -= 2 * len(left) + 1
        tail = min(best_fit(left, cap), fill_up(left, cap), key=lambda p: sum(t for t, _ in p))
        if n + sum(t for t, _ in tail) < best_n:
            best_n, best = n + sum(t for t, _ in tail), tail
            before = made
            while before:
                before, one = before
                best = [one, *best]
        if left:
            stack.append((branches(left, waste), left, n, waste, made))

    enter(counts, 0, 0, None)
    while stack and best_n > bound and steps[0] > 0:
        nxt, left, n, waste, made = stack[-1]
        step = next(nxt, None)
        if step is None:
            stack.pop()
            continue
        times, w, fill = step
        if waste + times * w <= (best_n - 1) * cap - total:
            enter(_less(left, fill, times), n + times, waste + times * w, (made, (times, fill)))
    return best


def pack_histogram(counts: dict[int, int], cap: int, work: int = SEARCH_WORK) -> list[tuple[int, tuple[int, ...]]]:
    """pack_runs with every piece's length written out."""
    return [(times, tuple(s for s, n in fill for _ in range(n))) for times, fill in pack_runs(counts, cap, work)]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, cap: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece."""

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        for pdf in batches:
            ids, texts, rows = pdf["id"].to_numpy(), pdf["text"].tolist(), []
            sized = [t or "" for t in texts]
            for a, b in chunks_of(sized, BLOCK_CHARS):
                rows = []
                for i, t in zip(range(a, b), enc.encode(sized[a:b])):
                    t = np.concatenate([t, end]).astype("<u4")
                    for p, s in enumerate(range(0, len(t), cap)):
                        part = t[s : s + cap]
                        rows.append((ids[i], p, s, len(part), zlib.crc32(part.tobytes())))
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            del pdf, texts, sized, rows
            release()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, cap: int = 2048, end_id: int = 0, work: int = SEARCH_WORK) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A document is its token ids and `end_id`; only a longer one is cut, at multiples of `cap`. Sequences hold at most
    `cap` tokens without gaps. The driver holds the histogram of lengths (at most cap numbers) and packs that; pieces
    find their places by their rank among pieces of equal length, counted in hash-dealt buckets, so a length with any
    share of the rows spreads over all tasks. `work` bounds the search, see pack_runs.

    Null text counts as empty: one piece with the end id. Repeated rows and equal ids are packed each by itself. A null
    id is kept. An empty table gives an empty one. Extra columns are ignored.
    """
    pieces, _ = materialize(token_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), cap, end_id), "pack-pieces")
    n = pieces.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    per = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    per, _ = materialize(per, "pack-counts")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # for each length the ranks that each filling takes: from, pieces in a sequence, place of the first, first sequence
    used: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    seq = 0
    for times, fill in pack_runs(counts, cap, work):
        at = 0
        for s, k in fill:
            first = used.get(s, 0)
            slots.setdefault(s, []).append((first, k, at, seq))
            used[s] = first + times * k
            at += s * k
        seq += times
    places = {s: tuple(np.array(c, np.int64) for c in zip(*v)) for s, v in slots.items()}

    before = per.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    before, _ = materialize(before, "pack-before")

    def place(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        length = left["length"].to_numpy()
        base = dict(zip(right["length"].tolist(), right["before"].tolist()))
        seqs, offs = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        edges = np.flatnonzero(np.diff(length, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            first, each, at, seq0 = places[int(length[a])]
            rank = base[int(length[a])] + np.arange(b - a)
            j = np.searchsorted(first, rank, "right") - 1
            turn, nth = np.divmod(rank - first[j], each[j])
            seqs[a:b], offs[a:b] = seq0[j] + turn, at[j] + nth * int(length[a])
        return left[["id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=seqs, offset=offs)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("bucket").cogroup(before.groupBy("bucket")).applyInPandas(place, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
