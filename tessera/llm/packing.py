"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. Windows of ``width`` tokens
are filled in the order of virtual time: a queue sends its tokens evenly, at a
speed of its share, and each window takes the next ``width`` tokens of all
queues. So every window holds the target shares, but for a queue's fraction of
a token and what the other queues' fractions add up to, which is dealt over all
of them by share. The tokens sent by a virtual time are a formula of it: a task
that knows where its documents stand in their queues cuts them into windows by
itself, and fractions carry over partitions without passing rows along. When a
queue runs dry the others share its room. Only the last window can be short.

Documents stand in their queue in the order of the written token table. Default shares are the sources' own token shares, so all
queues end together.

Nulls and ties: a null or empty text has its end token only; a null source is a
source of its own; repeated rows are packed each. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import written
from tessera.llm.textarrays import SPACES, byte_table, chunks, hash_runs, ragged

MAX_QUEUES = 4096      # beyond this many sources, those of less than a token a window share queues
MATRIX = 1 << 20       # counts (window, queue) computed at once
CACHE_WORDS = 1 << 21  # distinct words whose ids a worker remembers


# Pre-tokenising pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_characters() -> dict[str, int]:
    """The character that byte-level BPE files write for each byte: itself if printable, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """(encoder, bytes of each id) for a plain byte-level BPE file whose merges stand in
    the order of their ids, else None: a faster encoder gives the same ids from those ranks."""
    import json
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
    pre = spec.get("pre_tokenizer") or {}
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    plain = (spec["model"].get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
             and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and [vocab.get(x) for x in joined] == list(range(256, 256 + len(joined))))
    if not plain:
        return None
    import tiktoken
    of = byte_characters()
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(joined)}
    size = np.zeros(len(ranks), np.int64)
    for word, i in ranks.items():
        size[i] = len(word)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def after_wide_space(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character before each end may be white space outside ASCII."""
    second, third = buf[np.maximum(ends - 2, 0)], buf[np.maximum(ends - 3, 0)]
    return (buf[ends - 1] >= 128) & ((second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3)))


class WordIds:
    """Token ids of words, each distinct word encoded once in a worker.

    A byte-level BPE splits text before any single blank that stands between
    other characters, so such words can be encoded on their own, and words that
    begin with the blank can be encoded in a row.
    """

    def __init__(self, path: str):
        self.tok, self.fast, self.values = tokenizer(path), fast_encoder(path), byte_table()
        self.clear()

    def clear(self):
        self.known = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text_at, self.text_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text, self.written = np.zeros(1 << 18, np.uint8), 0

    def learn(self, key: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Keep the ids and the bytes of words whose hashes aren't known."""
        ids, size = self.encode_words(buf, starts, ends)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(max(len(ids), self.used), np.uint32)])
        self.ids[self.used:self.used + len(ids)] = ids
        order = np.argsort(key, kind="stable")
        at = (self.used + np.cumsum(size) - size)[order]
        where = np.searchsorted(self.known, key[order])
        self.known = np.insert(self.known, where, key[order])
        self.at, self.size = np.insert(self.at, where, at), np.insert(self.size, where, size[order])
        self.used += len(ids)
        length = ends - starts
        total = int(length.sum())
        if self.written + total > len(self.text):
            self.text = np.concatenate([self.text[:self.written], np.zeros(max(total, self.written), np.uint8)])
        self.text[self.written:self.written + total] = buf[ragged(starts, length)]
        self.text_at = np.insert(self.text_at, where, (self.written + np.cumsum(length) - length)[order])
        self.text_size = np.insert(self.text_size, where, length[order])
        self.written += total

    def strangers(self, buf, starts, ends, where) -> np.ndarray:
        """Words whose bytes differ from those of the known word with their hash."""
        length = ends - starts
        same = self.text_size[where] == length
        like = np.flatnonzero(same)
        differ = buf[ragged(starts[like], length[like])] != self.text[ragged(self.text_at[where[like]], length[like])]
        if differ.any():
            same[like[np.repeat(np.arange(len(like)), length[like])[differ]]] = False
        return np.flatnonzero(~same)

    def encode_words(self, buf, starts, ends):
        """(ids, number of ids of each word)"""
        def text(a, b):
            return buf[a:b].tobytes().decode("utf-8")
        in_row = SPACES[buf[starts]] & ~SPACES[buf[ends - 1]] & (ends - starts > 1) & ~after_wide_space(buf, ends)
        if self.fast is None:
            in_row[:] = False
        lists = {}
        odd = np.flatnonzero(~in_row).tolist()
        if odd:
            for i, e in zip(odd, self.tok.encode_batch([text(starts[i], ends[i]) for i in odd], add_special_tokens=False)):
                lists[i] = np.array(e.ids, np.uint32)
        row = np.flatnonzero(in_row)
        if not len(row):
            return (np.concatenate([lists[i] for i in odd]), np.array([len(lists[i]) for i in odd], np.int64))
        length = (ends - starts)[row]
        joined = buf[ragged(starts[row], length)].tobytes().decode("utf-8")
        ids = self.fast[0].encode_to_numpy(joined, allowed_special=set(), disallowed_special=())
        sums = np.cumsum(self.fast[1][ids])
        cut = np.searchsorted(sums, np.cumsum(length), "left") + 1
        size = np.zeros(len(starts), np.int64)
        size[row] = np.diff(cut, prepend=0)
        for i in odd:
            size[i] = len(lists[i])
        out = np.empty(int(size.sum()), np.uint32)
        first = np.cumsum(size) - size
        out[ragged(first[row], size[row])] = ids
        for i in odd:
            out[first[i]:first[i] + size[i]] = lists[i]
        return out, size

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        blank = SPACES[buf]
        head = np.zeros(len(buf) + 1, bool)
        head[1:-2] = blank[1:-1] & ~blank[:-2] & ~blank[2:]
        heads = np.flatnonzero(head)
        head[heads[after_wide_space(buf, heads)]] = False
        head[off] = True
        starts = np.flatnonzero(head[:-1])
        ends = np.append(starts[1:], len(buf))
        h = hash_runs(buf, starts, ends, self.values)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known):
            new = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, u), len(self.known) - 1)] != u)
        else:
            new = np.arange(len(u))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.clear()
            new = np.arange(len(u))
        if len(new):
            self.learn(u[new], buf, starts[first[new]], ends[first[new]])
        where = np.searchsorted(self.known, u)[back]
        at, size, known = self.at[where], self.size[where], self.ids
        odd = self.strangers(buf, starts, ends, where)
        if len(odd):
            more, size[odd] = self.encode_words(buf, starts[odd], ends[odd])
            at[odd] = len(known) + np.cumsum(size[odd]) - size[odd]
            known = np.concatenate([known, more])
        ids = known[ragged(at, size)]
        sums = np.concatenate([[0], np.cumsum(size)])
        cut = np.searchsorted(starts, off)
        return ids, sums[cut[1:]] - sums[cut[:-1]]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """Token table: (id, source, before, n, ids, part) with the end token 0 of every document.

    ``before`` counts the tokens of the same source earlier in the part.

    ``ids`` holds little-endian 16-bit ids where the vocabulary fits them, else 32-bit.
    """
    kind = "<u2" if tokenizer(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"

    def task(batches):
        words, sent = word_ids(vocabulary), {}
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                ids, n = words.encode(buf, off)
                ends = np.cumsum(n)
                flat = np.insert(ids, ends, 0).astype(kind)
                size = np.dtype(kind).itemsize
                bounds = np.concatenate([[0], np.cumsum(n + 1)]) * size
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(bounds.astype(np.int64)),
                                                                                  pa.py_buffer(flat.tobytes())])
                source, before = batch.column(2).slice(i, j - i), []
                for name, count in zip(source.to_pylist(), (n + 1).tolist()):
                    before.append(sent.get(name, 0))
                    sent[name] = before[-1] + count
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), source, pa.array(before, pa.int64()), pa.array(n + 1), data.cast(pa.binary())],
                    names=["id", "source", "before", "n", "ids"])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(source_col).cast("string").alias("source"))
    out = rows.mapInArrow(task, "id long, source string, before long, n long, ids binary")
    return out.withColumn("part", F.spark_partition_id())


class Rounds:
    """Which window and offset each queue position goes to.

    ``totals`` are the queues' tokens, ``shares`` their target shares. By the
    virtual time v a queue has sent floor(v * share + phase) tokens, at most its
    total; phases spread queues of equal shares. A window ends at the least v by
    which all have sent enough; of tokens of the same time those of the first
    queues go first. Queues without a share follow the others, by their totals.
    """

    def __init__(self, totals: list[int], shares: list[float], width: int):
        self.width = width
        self.totals = np.array(totals, np.int64)
        share = np.maximum(np.array(shares, float), 0.0)
        self.total = int(self.totals.sum())
        self.phase = np.arange(len(self.totals)) * 0.6180339887498949 % 1.0
        self.turns = []    # (queues, speeds, tokens before, tokens up to here, fluid knots: time, tokens)
        before = 0
        for who, speed in ((np.flatnonzero((share > 0) & (self.totals > 0)), share),
                           (np.flatnonzero(~(share > 0) & (self.totals > 0)), self.totals.astype(float))):
            if not len(who):
                continue
            n, speed = self.totals[who], speed[who] / speed[who].sum()
            dry = np.sort((n + 1) / speed)
            order = np.argsort((n + 1) / speed, kind="stable")
            going = np.concatenate([[1.0], 1.0 - np.cumsum(speed[order])])[:-1]
            sent = np.cumsum(np.diff(dry, prepend=0.0) * np.maximum(going, 0.0))
            last = np.concatenate([[0.0], dry]), np.concatenate([[0.0], np.maximum.accumulate(sent)])
            self.turns.append((who, speed, before, before + int(n.sum()), last))
            before += int(n.sum())

    def counts(self, turn, v: np.ndarray) -> np.ndarray:
        """Tokens sent by each of the turn's queues at times ``v``."""
        who, speed = turn[:2]
        out = np.floor(np.minimum(np.multiply.outer(v, speed) + self.phase[who], self.totals[who])).astype(np.int64)
        out[v <= 0] = 0
        return out

    def sent(self, k: np.ndarray) -> np.ndarray:
        """Tokens each queue has sent after ``k`` windows (last axis: queues)."""
        goal = np.minimum(np.asarray(k, np.int64) * self.width, self.total)
        out = np.zeros((len(goal), len(self.totals)), np.int64)
        for turn in self.turns:
            who, speed, first, end, (time, fluid) = turn
            whole = goal >= end
            out[np.ix_(whole, who)] = self.totals[who]
            at = np.flatnonzero((goal > first) & ~whole)
            if not len(at):
                continue
            want = goal[at] - first
            # times are searched as the integers that order them; the fluid count is off by a token a queue at most
            slack = 2.0 * len(who) + 2 + 1e-6 * want
            low = np.interp(want - slack, fluid, time).view(np.int64) * (want > slack)
            high = np.nextafter(np.where(want + slack < fluid[-1], np.interp(want + slack, fluid, time), time[-1] * 2), np.inf).view(np.int64)
            low = np.where(self.counts(turn, low.view(float)).sum(1) < want, low, 0)
            high = np.where(self.counts(turn, high.view(float)).sum(1) >= want, high, np.float64(time[-1] * 2).view(np.int64))
            while (high - low > 1).any():
                mid = low + (high - low) // 2
                enough = self.counts(turn, mid.view(float)).sum(1) >= want
                low, high = np.where(enough, low, mid), np.where(enough, mid, high)
            sure = self.counts(turn, low.view(float))
            tied = self.counts(turn, high.view(float)) - sure
            room = (want - sure.sum(1))[:, None]
            out[np.ix_(at, who)] = sure + np.clip(room - (np.cumsum(tied, 1) - tied), 0, tied)
        return out

    def holding(self, queue: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The window in which a queue sends each position."""
        guess = np.zeros(len(position), np.int64)
        for turn in self.turns:
            who, speed, first = turn[:3]
            place = np.full(len(self.totals), -1)
            place[who] = np.arange(len(who))
            mine = np.flatnonzero(place[queue] >= 0)
            rows = max(1, MATRIX // max(1, len(self.totals)))
            for lo in range(0, len(mine), rows):
                r = mine[lo:lo + rows]
                v = (position[r] + 1 - self.phase[queue[r]]) / speed[place[queue[r]]]
                guess[r] = (first + self.counts(turn, v).sum(1) - 1) // self.width
        low = np.clip(guess, 0, max(0, (self.total - 1) // self.width))
        while True:
            u, back = np.unique(low, return_inverse=True)
            off = np.zeros(len(low), np.int64)
            rows = max(1, MATRIX // max(1, len(self.totals)))
            for lo in range(0, len(u), rows):
                mine = np.flatnonzero((back >= lo) & (back < lo + rows))
                i, q = back[mine] - lo, queue[mine]
                some = u[lo:lo + rows]
                off[mine] = (self.sent(some + 1)[i, q] <= position[mine]).astype(int) - (self.sent(some)[i, q] > position[mine])
            if not off.any():
                return low
            low = np.clip(low + off, 0, max(0, (self.total - 1) // self.width))

    def cut(self, queue, start: np.ndarray, n: np.ndarray):
        """Pieces of the positions start..start+n of a queue (one for all, or one each): (row, position, length, window, offset)."""
        if not len(start):
            return [np.zeros(0, np.int64)] * 5
        queue = np.broadcast_to(np.asarray(queue, np.int64), len(start))
        some = np.flatnonzero(n > 0)
        edge = self.holding(np.tile(queue[some], 2), np.concatenate([start[some], (start + n)[some] - 1]))
        first, last = edge[:len(some)], edge[len(some):]
        row, k = np.repeat(some, last - first + 1), ragged(first, last - first + 1)
        order = np.argsort(k, kind="stable")
        row, k = row[order], k[order]
        windows, begin = np.unique(k, return_index=True)
        begin = np.append(begin, len(k))
        out = []
        rows = max(1, MATRIX // max(1, len(self.totals)))
        for lo in range(0, len(windows), rows):
            part = windows[lo:lo + rows]
            ends, at = np.unique(np.concatenate([part, part + 1]), return_inverse=True)
            sent = self.sent(ends)
            low, high = sent[at[:len(part)]], sent[at[len(part):]]
            skip = np.cumsum(high - low, 1) - (high - low)
            piece = slice(begin[lo], begin[lo + len(part)])
            r, w = row[piece], k[piece]
            i, q = np.searchsorted(part, w), queue[r]
            a, b = np.maximum(start[r], low[i, q]), np.minimum(start[r] + n[r], high[i, q])
            has = b > a
            out.append([z[has] for z in (r, a, b - a, w, skip[i, q] + a - low[i, q])])
        return [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def queue_names(per: DataFrame, width: int, targets: dict | None) -> DataFrame:
    """(name, queue_name, n, share) of every source: a queue each, or, where there are more than ``MAX_QUEUES``
    sources, those of less than a token a window in queues by the hash of their name. Shares are
    by source; sources without a target have queues of their own."""
    by = per.groupBy("name").agg(F.sum("n").alias("n"))
    if targets is None:
        by = by.withColumn("share", F.col("n").cast("double"))
    else:
        given = per.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "name string, share double")
        by = by.join(given, "name", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    by = written(by, "sources")
    if by.count() <= MAX_QUEUES:
        return by.withColumn("queue_name", F.col("name"))
    total = by.agg(F.sum("share")).first()[0] or 0.0
    groups = max(1, MAX_QUEUES // 2, MAX_QUEUES - width)
    small = F.col("share") * F.lit(float(width)) < F.lit(total) if total else F.lit(True)
    hashed = F.concat(F.when(F.col("share") > 0, F.lit("\0group")).otherwise(F.lit("\0rest")),
                      F.pmod(F.xxhash64("name"), F.lit(groups)).cast("string"))
    return by.withColumn("queue_name", F.when(small, hashed).otherwise(F.col("name")))


PIECES = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, width: int = 1024, targets: dict | None = None, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of all documents: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are the piece's token ids, little-endian 32-bit. ``targets`` gives
    token shares by source (None: their own shares); sources that it leaves out
    follow once the others are used up.
    """
    spark = docs.sparkSession
    table = written(tokens(docs, vocabulary, id_col, text_col, source_col), "tokens")
    name = F.coalesce("source", F.lit("\0null"))
    per = table.groupBy("part", name.alias("name")).agg(F.sum("n").alias("n"))
    per = written(per, "parts")
    sources = queue_names(per, width, targets)
    queued = per.join(sources.select("name", "queue_name"), "name")
    queues = sorted(sources.groupBy("queue_name").agg(F.sum("n").alias("n"), F.sum("share").alias("share")).collect())
    totals, shares = [q["n"] for q in queues], [q["share"] for q in queues]
    plan = spark.sparkContext.broadcast(Rounds(totals, shares, width))
    numbers = spark.createDataFrame([(q["queue_name"], i) for i, q in enumerate(queues)], "queue_name string, queue int")
    earlier = Window.partitionBy("queue").orderBy("part", "name").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(queued.join(numbers, "queue_name").select(
        "part", "name", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases")
    rows = table.withColumn("name", name).join(bases, ["part", "name"]).select(
        "id", "n", "ids", "queue", (F.col("base") + F.col("before")).alias("start"))

    def task(batches):
        rounds = plan.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                n, queue, start = (batch.column(i).to_numpy() for i in (1, 3, 4))
                flat = [np.frombuffer(x.as_buffer(), "<u2" if len(x.as_buffer()) == 2 * m else "<u4").astype("<u4")
                        for x, m in zip(batch.column(2), n)]
                row, at, length, window, offset = rounds.cut(queue, start, n)
                order = np.lexsort((at, row))
                row, at, length, window, offset = (z[order] for z in (row, at, length, window, offset))
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)),
                                                                                    pa.py_buffer(np.concatenate(flat).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(at - start[row]), pa.array(length), ids.cast(pa.binary()),
                     pa.array(n[row]), pa.array(window), pa.array(offset)],
                    names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    return rows.mapInArrow(task, PIECES)
