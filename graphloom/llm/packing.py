"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut, each into full pieces and a
rest.  The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) is all that planning sees:

1. lengths are put into classes of neighbours with about equal numbers of tokens, each as long as its longest (a class is
   one length if there are few); the shortest pieces are kept back, as many as rounding up to classes can leave room for;
2. the configuration linear program (minimise the number of sequences, every class covered as often as it occurs) is
   solved by multiplicative weights over fixed demands: each round a knapsack dynamic program prices the best configuration
   under the weights, it gets a share, and the weights of what it covers fall.  The weights of every round, divided by that
   price, are a solution of the dual program and so bound the optimum; rounds end when the two values meet within a gap;
3. the solution is rounded down to whole sequences.  What is left of each class is priced again under the weights of the best
   bound, now with the pieces that are left as limits, and placed a configuration at a time;
4. the pieces kept back go best-fit by decreasing length into what room is left, with equal bins handled as one, so that work
   depends on the histogram alone.

The plan is a table of rank ranges: the ``r``-th piece of a length goes to a computed sequence and offset.  Ranks are
counted in buckets of each length, so a length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.store import keep

#: Lengths are put into so many classes for the program; its value and the dual bound are to meet within the gap.
CLASSES = 64
GAP = 0.01
#: Pricing ends here at the latest (the gap that was reached is a figure of the plan); between two prices weights are updated so often.
ROUNDS, UPDATES = 400, 150
#: How strongly an update changes weights, over the root of the largest share that a configuration covers.
STEP = 2.0
#: Pieces of at most this share of the capacity may be kept back to fill gaps.
SHORT = 1 / 8


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer file.

    The tokenizers served here drop white space and never join across it.  Text of plain characters below U+0250 is
    split as the file's pattern says and its words go through the merges in bulk; white-space chunks with any other
    character go through the unchanged tokenizer.

    The merges run in a second library that always merges the pair whose union has the lowest rank.  That is the
    same as following the list of merges when ranks are in the order of the list and every token is what its own
    characters merge to; both are verified here, tokens that fail the second are left out (no text reaches them), and if
    anything else is unlike that, all texts take the unchanged tokenizer.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END = "</w>"
    #: Stands for the end of a word; chunks that hold it aren't plain.
    MARK = "\x7f"

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.find = regex.compile(self.PATTERN).findall
        self.plain = regex.compile(r"[!-~¡-įı-ɏ]*").fullmatch
        self.spread = re.compile(rf"[!-~¡-įı-ɏ{self.MARK}]*").fullmatch
        self.simple = re.compile(rf"[a-zß-öø-ÿ.,{self.MARK}]*").fullmatch
        spec = json.loads(self.exact.to_str())
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        known = steps == ["NFC", "Replace", "Lowercase"] and split[:1] == [self.PATTERN] and spec["model"].get("end_of_word_suffix") == self.END
        self.merges = self._ranked(spec["model"]) if known else None

    def _ranked(self, model: dict):
        import tiktoken
        from tokenizers import pre_tokenizers

        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab.get("".join(m), -1) for m in merges]
        singles = [i for w, i in vocab.items() if len(w.removesuffix(self.END)) == 1]
        if made != sorted(set(made)) or min(made) < 0 or len(singles) != 512 or max(singles) > made[0] or len(vocab) != 512 + len(made):
            return None
        # The library writes bytes as printable characters: those that are already printable stand for themselves.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
        if set(letters) != set(pre_tokenizers.ByteLevel.alphabet()):
            return None
        mark = self.MARK.encode()
        ranks: dict[bytes, int] = {}
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for w, i in vocab.items():
            end = len(w) > len(self.END) and w.endswith(self.END)
            raw = bytes(letters[c] for c in (w.removesuffix(self.END) if end else w))
            self.ends[i] = end
            if len(raw) == 1 and not end or mark not in raw:
                ranks[raw + mark * end] = i
        dead = [w for w, i in self._isolated(vocab, merges) if i != vocab[w]]
        for w in dead:
            end = w.endswith(self.END)
            ranks.pop(bytes(letters[c] for c in w.removesuffix(self.END)) + mark * end, None)
        return tiktoken.Encoding("words", pat_str=rf"[^{self.MARK}]*{self.MARK}", mergeable_ranks=ranks, special_tokens={})

    def _isolated(self, vocab: dict[str, int], merges: list):
        """Each merged token with the id that its own characters merge to in isolation, -1 if several."""
        rank = {tuple(p): i for i, p in enumerate(merges)}
        for p in merges:
            w = "".join(p)
            body = w.removesuffix(self.END)
            parts = list(body)
            if body != w:
                parts[-1] += self.END
            while len(parts) > 1:
                best, at = min(((rank.get((parts[k], parts[k + 1]), len(rank)), k) for k in range(len(parts) - 1)))
                if best == len(rank):
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield w, vocab[parts[0]] if len(parts) == 1 else -1

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")

    def _plain(self, low: str) -> np.ndarray:
        """The ids of lower-case words of plain characters, a mark after each."""
        mark = self.MARK
        if self.simple(low) and not any(x in low for x in ("..", ",,", ".,", ",.")):
            low = low.replace(".", f"{mark}.{mark}").replace(",", f"{mark},{mark}").replace(mark * 2, mark).removeprefix(mark)
        else:
            low = mark.join(self.find(low.replace(mark, " "))) + mark
        return self.merges.encode_to_numpy(low)

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text."""
        # Python takes U+001C to U+001F for white space, the tokenizer does not.
        if self.merges is None or any(c in text for c in "\x1c\x1d\x1e\x1f\x7f") or any(s in text for s in self.special):
            return self._exact(text)
        chunks = text.split()
        if not chunks:
            return np.empty(0, "<u4")
        whole = self.MARK.join(chunks) + self.MARK
        if whole.isascii() or self.spread(whole):
            return self._plain(whole.lower())
        parts = []
        for plain, some in itertools.groupby(chunks, lambda c: self.plain(c) is not None):
            parts.append(self._plain((self.MARK.join(some) + self.MARK).lower()) if plain else self._exact(" ".join(some)))
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = encoder(path)
    end = np.array([end_id], "<u4")
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(own.ids(text.as_py() or ""), end)
            for n, start in enumerate(range(0, len(ids), capacity)):
                piece = ids[start : start + capacity]
                rows.append((doc, n, start, len(piece), zlib.crc32(piece)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every row; null text counts as empty (the end id alone)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity, end_id=end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _price(worth: np.ndarray, sizes: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest worth, at most ``limits`` of each size: a knapsack by dynamic programming over the
    capacity, with each limit taken apart into powers of two.  Returns how often each size is taken."""
    best = np.zeros(capacity + 1)
    layers: list[tuple[int, int, np.ndarray]] = []
    for i in np.flatnonzero((limits > 0) & (worth > 0) & (sizes <= capacity)):
        size, left, some = int(sizes[i]), min(int(limits[i]), capacity // int(sizes[i])), 1
        while left:
            some = min(some, left)
            with_it = best[: capacity + 1 - some * size] + some * worth[i]
            better = with_it > best[some * size :]
            layers.append((int(i), some, better))
            best[some * size :] = np.maximum(with_it, best[some * size :])
            left -= some
            some *= 2
    out = np.zeros(len(sizes), np.int64)
    c = capacity
    for i, some, better in reversed(layers):
        at = c - some * int(sizes[i])
        if at >= 0 and better[at]:
            out[i] += some
            c = at
    return out


@dataclass
class Program:
    """A solution of the configuration program: configurations and how many sequences each gets, covering all demands, with
    its value, the best dual bound of the optimum, and the dual weights that give it."""

    configurations: np.ndarray
    times: np.ndarray
    value: float
    bound: float
    weights: np.ndarray


def program(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS, step: float = STEP) -> Program:
    """Multiplicative weights on both sides over the demands ``counts``, which stay as they are.

    Sizes have weights that fall with the share of their demand that configurations cover, configurations have weights that
    rise with the weights of what they cover; both look one update ahead, which makes their averages settle fast.  The
    knapsack then prices the averaged weights, which bounds the optimum, and adds the best configuration to those known.
    """
    demand, scale = counts.astype(float), float(sizes @ counts) / capacity
    known = {c.tobytes(): None for c in np.diag(np.minimum(capacity // sizes, counts))}  # each size alone
    covers = np.array([np.frombuffer(k, np.int64) * scale / demand for k in known])
    size, config = sizes * demand / (sizes @ demand), np.full(len(known), 1 / len(known))
    bound, weights, value, times = 0.0, sizes / capacity, np.inf, config
    for _ in range(rounds):
        worth = size / demand
        best = _price(worth, sizes, counts, capacity)
        price = float(best @ worth)
        if size.sum() / price > bound:
            bound, weights = size.sum() / price, worth / price
        if value <= (1 + gap) * bound:
            break
        if best.tobytes() not in known:
            known[best.tobytes()] = None
            covers = np.vstack([covers, best * scale / demand])
            config = np.append(config * (1 - 1 / len(known)), 1 / len(known))
        eta = step / np.sqrt(covers.max())
        log_size, log_config = np.log(np.maximum(size, 1e-30)), np.log(np.maximum(config, 1e-30))
        all_size, all_config = np.zeros(len(size)), np.zeros(len(config))
        was_size, was_config = covers.T @ config, covers @ size
        for _ in range(UPDATES):
            covered, paid = covers.T @ config, covers @ size
            log_size -= eta * (2 * covered - was_size)
            log_config += eta * (2 * paid - was_config)
            was_size, was_config = covered, paid
            log_size -= log_size.max()
            log_config -= log_config.max()
            size, config = np.exp(log_size), np.exp(log_config)
            size /= size.sum()
            config /= config.sum()
            all_size += size
            all_config += config
        size, mean = all_size / UPDATES, all_config / UPDATES
        least = float((covers.T @ mean).min())
        if scale / max(least, 1e-300) < value:
            value, times = scale / least, mean * scale / least
    table = np.array([np.frombuffer(k, np.int64) for k in known])
    return Program(table, np.append(times, np.zeros(len(table) - len(times))), value, bound, weights)


def _classes(lens: np.ndarray, have: np.ndarray, classes: int) -> list[tuple[int, int]]:
    """Ranges of ascending lengths with about equal numbers of tokens."""
    if len(lens) <= classes:
        return [(i, i + 1) for i in range(len(lens))]
    tokens = np.cumsum(lens * have)
    cuts = np.unique(np.searchsorted(tokens, tokens[-1] * np.arange(1, classes) / classes) + 1)
    edges = [0, *(int(c) for c in cuts if c < len(lens)), len(lens)]
    return [(a, b) for a, b in itertools.pairwise(edges) if a < b]


@dataclass
class Plan:
    """``rows (length, first rank, last rank + 1, how many to a sequence, first sequence, offset of the first)``, sorted, and
    figures: sequences, those that the program's configurations made, and its value and bound."""

    rows: np.ndarray
    sequences: int = 0
    full: int = 0
    by_program: int = 0
    value: float = 0.0
    bound: float = 0.0


def plan(lengths: list[int], counts: list[int], capacity: int, classes: int = CLASSES) -> Plan:
    """Where the pieces of each length go.  Every piece is covered exactly once."""
    order = np.argsort(lengths)
    lens, have = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    used = np.zeros(len(lens), np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    out = Plan(np.empty((0, 6), np.int64))

    def place(times: int, config: dict[int, int]) -> None:
        offset = 0
        for i in sorted(config, reverse=True):
            k, n = config[i], int(lens[i])
            rows.append((n, int(used[i]), int(used[i]) + times * k, k, out.sequences, offset))
            used[i] += times * k
            offset += k * n
        out.sequences += times

    if len(lens) and lens[-1] == capacity:
        out.full = int(have[-1])
        place(out.full, {len(lens) - 1: 1})
    rest = int((lens < capacity).sum())
    left = have[:rest].copy()
    # Bins of equal contents: free space -> [how many, {index of length: how often}]
    bins: dict[int, list[list]] = {}
    free: list[int] = []

    def shelve(times: int, config: dict[int, int]) -> None:
        space = capacity - sum(k * int(lens[i]) for i, k in config.items())
        if space not in bins:
            bisect.insort(free, space)
        bins.setdefault(space, []).append([times, config])

    if rest:
        groups = _classes(lens[:rest], left, classes)
        tokens = lens[:rest] * left
        top = np.repeat([int(lens[b - 1]) for _, b in groups], [b - a for a, b in groups])
        room = int(((top - lens[:rest]) * left).sum())
        kept_back = 0
        if room:
            kept_back = min(int(np.searchsorted(np.cumsum(tokens), room, side="right")), int(np.searchsorted(lens[:rest], SHORT * capacity, side="right")))
        if kept_back:
            groups = [(a + kept_back, b + kept_back) for a, b in _classes(lens[kept_back:rest], left[kept_back:], classes)]
        if groups:
            sizes = np.array([int(lens[b - 1]) for _, b in groups])
            held = np.zeros(len(groups), np.int64)  # pieces of configurations that best fit is to place
            amount = lambda: np.array([int(left[a:b].sum()) for a, b in groups]) - held
            # Too strong a step doesn't settle; weaker ones take longer.
            solved = program(sizes, amount(), capacity)
            for weaker in (STEP / 3, STEP / 9):
                if solved.value > (1 + 3 * GAP) * solved.bound:
                    solved = min(solved, program(sizes, amount(), capacity, step=weaker), key=lambda x: x.value)
            out.value, out.bound = solved.value, solved.bound
            at = [b - 1 for _, b in groups]  # the longest piece left of each class

            def fill(times: int, config: np.ndarray) -> None:
                """So many sequences of a configuration, filled with the longest pieces left of each class.  Of three pieces or
                more the shortest is left to best fit, which finds one that fits the gap exactly if there is any."""
                out.by_program += times
                if config.sum() > 1:
                    last = int(np.flatnonzero(config)[0])
                    config = config.copy()
                    config[last] -= 1
                    held[last] += times
                while times:
                    own: dict[int, int] = {}
                    alike = times
                    for g in np.flatnonzero(config):
                        need = int(config[g])
                        while need:
                            while not left[at[g]]:
                                at[g] -= 1
                            some = min(need, int(left[at[g]]) - own.get(at[g], 0))
                            if some:
                                own[at[g]] = own.get(at[g], 0) + some
                                need -= some
                            if need:
                                alike = 1
                                nxt = at[g] - 1
                                while own.get(nxt, 0) >= left[nxt]:
                                    nxt -= 1
                                more = min(need, int(left[nxt]))
                                own[nxt] = more
                                need -= more
                                while need:
                                    nxt -= 1
                                    more = min(need, int(left[nxt]))
                                    if more:
                                        own[nxt] = more
                                        need -= more
                    alike = min(alike, *(int(left[i]) // k for i, k in own.items()))
                    for i, k in own.items():
                        left[i] -= alike * k
                    shelve(alike, own)
                    times -= alike

            for k in np.argsort(-solved.times, kind="stable"):
                config, still = solved.configurations[k], amount()
                whole = min(int(solved.times[k]), int((still[config > 0] // config[config > 0]).min()))
                if whole:
                    fill(whole, config)
            while (still := amount()).any():
                config = _price(solved.weights, sizes, still, capacity)
                fill(int((still[config > 0] // config[config > 0]).min()), config)
    # The pieces kept back: best fit by decreasing length, on bins that are alike taken together.
    for i in range(rest - 1, -1, -1):
        n, need = int(lens[i]), int(left[i])
        while need:
            at_space = bisect.bisect_left(free, n)
            if at_space == len(free):
                most = min(capacity // n, need)
                shelve(need // most, {i: most})
                need -= need // most * most
                continue
            space = free[at_space]
            group = bins[space][-1]
            k = min(space // n, need)
            times = min(group[0], need // k)
            group[0] -= times
            config = dict(group[1])
            if not group[0]:
                bins[space].pop()
                if not bins[space]:
                    del bins[space]
                    free.pop(at_space)
            config[i] = config.get(i, 0) + k
            shelve(times, config)
            need -= times * k
    for some in bins.values():
        for times, config in some:
            place(times, config)
    out.rows = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return out


def _assign(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts: dict[int, tuple[int, int]] = {}
    if len(table):
        value, first = np.unique(table[:, 0], return_index=True)
        starts = {int(v): (int(a), int(b)) for v, a, b in zip(value, first, [*first[1:], len(table)], strict=True)}
    for batch in batches:
        length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
        row = np.empty(len(length), np.int64)
        for v in np.unique(length):
            a, b = starts[int(v)]
            here = length == v
            row[here] = a + np.searchsorted(table[a:b, 1], rank[here], side="right") - 1
        t = table[row]
        place = rank - t[:, 1]
        out = [*(batch.column(i) for i in range(5)), pa.array(t[:, 4] + place // t[:, 3]), pa.array(t[:, 5] + place % t[:, 3] * length)]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, bucket_rows: int = 2_000) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null text is an empty document (the end id alone).  Repeated rows are packed as often as they occur, and null
    ids are kept.  An empty table gives no rows.  Other columns are ignored.
    """
    cut = keep(pieces(docs, tokenizer, capacity, end_id), "pieces")
    order = ["doc_id", "piece", "ids_crc32"]
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()  # at most `capacity` rows
    table = plan([r["length"] for r in histogram], [r["n"] for r in histogram], capacity).rows
    # Each length has buckets by its own count; this table has as many rows as the histogram.
    buckets = docs.sparkSession.createDataFrame([(r["length"], -(-r["n"] // bucket_rows)) for r in histogram], "length long, buckets long")
    cut = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets")))
    sizes = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = cut.withColumn("k", F.row_number().over(within)).join(base, ["length", "bucket"]).select(*order[:2], "start", "length", "ids_crc32", (F.col("base") + F.col("k") - 1).alias("rank"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(partial(_assign, table=table), kinds)
