"""Best-fit packing of tokenised documents into sequences by bin completion.

Documents become ids of a word-level BPE vocabulary and an end id; one longer than a sequence is cut into whole sequences
and a rest.  What is packed are the pieces' lengths.  A length lies between 1 and the capacity, so the lengths of any table
are a histogram of at most ``capacity`` rows, which is all that the search sees, however many documents there are:

* ``best_fit`` packs the histogram by best fit, longest first, many equal sequences at a time; that is the first incumbent.
* ``completed`` is bin completion: around the largest length left it enumerates fillings that no other filling dominates,
  takes each as often as the lengths allow (once at a time when few sequences are left), and gives a branch up when the
  waste it has, with the least waste of what is left, can't beat the incumbent.
* The solution is a table of fillings, each with its number of sequences; a piece finds its place by its rank among the
  pieces of its length.  Ranks are counted in hashed chunks, so a length that a third of all pieces share is many tasks' work.

The search ends when a solution meets the lower bound, when every branch is done, or after NODES nodes; then the incumbent
is the result.  It always places every piece.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they occur; pieces of one
length are ranked by document, piece and checksum, so reruns agree up to rows that are equal in all three; a document of
any length is cut whole; an empty table gives an empty table; further columns are left out."""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, for_python, numbered, shuffle_partitions, tidy

#: Tokens of a sequence, and the id at the end of each document.
CAPACITY, END = 4096, 1
#: Nodes that the search visits, fillings it branches on at each, and combinations it looks at for them.
NODES, WIDTH, LOOKS = 4_000, 6, 200
#: Sequences that are left when fillings are taken one at a time.
SINGLE = 48
#: Bytes of words and ids that a worker remembers, with what Python needs to hold them, in each of two generations.
MEMO_BYTES, ENTRY = 64 << 20, 200
#: White space of the vocabulary's splitter, fixed values; Python's own also has the four separators FS, GS, RS and US.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stands for the end of a word, in bytes: UTF-8 has no such byte.
WORD_END = b"\xff"


# -- tokens


def splitter(path: str) -> tuple[str, dict[int, str]]:
    """The vocabulary's splitter as a pattern of Python's (contractions, runs of letters, single numbers, runs of the rest),
    and the lower case of letters that Python doesn't know.

    Letters and numbers are those of Python's character table; the vocabulary is asked about the few that only a later
    table has."""
    from tokenizers import Tokenizer

    library, later, lower = Tokenizer.from_file(path), regex.compile(r"[\p{L}\p{N}]").match, {}
    split = library.pre_tokenizer.pre_tokenize_str
    runs: dict[str, list[list[int]]] = {"L": [], "N": []}
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        if kind == "Cn" and later(chr(code)):
            kind = "L" if len(split("a" + chr(code))) == 1 else "N" if len(split(2 * chr(code))) == 2 else kind
            if library.normalizer.normalize_str(chr(code)) != chr(code):
                lower[code] = library.normalizer.normalize_str(chr(code))
        found = runs.get(kind[0])
        if found is not None:
            if found and found[-1][1] == code - 1:
                found[-1][1] = code
            else:
                found.append([code, code])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found) for found in runs.values())
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+"
    return pattern, lower


def word_ranks(path: str) -> dict[bytes, int]:
    """Ids by bytes (a word's end as WORD_END) of the tokens that can occur.

    Merging by the rank of the merged bytes gives what merging by pairs gives if every token encodes to itself: what is
    merged within a span doesn't depend on what is around it, so two neighbours that make up a token's bytes are the pair
    that it comes from.  Tokens that don't encode to themselves never occur and are left out."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes shown as themselves
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    byte = {c: b for b, c in letter.items()}
    end, bpe = model["end_of_word_suffix"], Tokenizer.from_file(path).model
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    if ids != sorted(ids) or min(ids, default=512) < 512:
        raise ValueError("the vocabulary's ids don't follow its merges")
    places = {pair: k for k, pair in enumerate(merges)}
    ranks = {}
    for token, rank in model["vocab"].items():
        whole = token.endswith(end)
        word = token[: -len(end)] if whole else token
        if rank < 512 or ([t.id for t in bpe.tokenize(word)] == [rank] if whole else len(_merged(places, word)) == 1):
            ranks[bytes(byte[c] for c in word) + (WORD_END if whole else b"")] = rank
    return ranks


def _merged(places: dict[tuple[str, str], int], word: str) -> list[str]:
    """What merging leaves of a token's letters, inside a word."""
    parts = list(word)
    while len(parts) > 1:
        best = min(zip(parts, parts[1:]), key=lambda pair: places.get(pair, len(places)))
        if best not in places:
            break
        k = next(k for k, pair in enumerate(zip(parts, parts[1:])) if pair == best)
        parts[k : k + 2] = ["".join(best)]
    return parts


class WordEncoder(dict):
    """Ids of whole texts, as little-endian unsigned 32-bit integers; words between white space are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, lower: dict[int, str]):
        import tiktoken

        super().__init__()
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.older, self.used, self.lower, self.findall = {}, 0, lower, re.compile(pattern).findall

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            if word.isalpha():
                parts = (word,)
            elif word[-1] in ".,;:!?" and word[:-1].isalpha():
                return self._kept(word, self[word[:-1]] + self[word[-1]])
            else:
                parts = self.pieces(word)
            ids = [i for part in parts for i in self.core(part.encode() + WORD_END)]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        return self._kept(word, packed)

    def pieces(self, text: str) -> list[str]:
        return self.findall(text.translate(self.lower) if not text.isascii() else text)

    def _kept(self, word: str, packed: bytes) -> bytes:
        if len(word) <= 64:
            if self.used >= MEMO_BYTES:
                self.older = dict(self)
                self.clear()
                self.used = 0
            self[word] = packed
            self.used += ENTRY + 2 * len(word) + len(packed)
        return packed

    def packed(self, text: str) -> bytes:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-cased by itself, not by its place in the word
        text = text.lower()
        separators = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return b"".join(map(self.__getitem__, self.pieces(text) if separators else text.split()))


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int) for every piece of every row.

    The driver reads the vocabulary, whose size is that of its file, and broadcasts it."""
    ranks = docs.sparkSession.sparkContext.broadcast((word_ranks(path), *splitter(path)))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    step = 4 * capacity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = WordEncoder(*ranks.value), struct.pack("<I", end)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                packed = encoder.packed(text.as_py() or "") + last
                for n, at in enumerate(range(0, len(packed), step)):
                    part = packed[at : at + step]
                    rows.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return for_python(docs, F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(each), schema)


# -- the search, over a histogram of lengths

#: A filling: (length, how often) of one sequence, from the longest; a solution: fillings with their number of sequences.
Filling = tuple[tuple[int, int], ...]


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs: lengths above half can't meet, and shorter ones fill at most what those leave."""
    capacity = len(counts) - 1
    number = np.concatenate([[0], np.cumsum(counts)])  # number[k]: lengths below k
    total = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    half = capacity // 2
    floor = np.arange(half + 1)
    alone = number[capacity + 1] - number[capacity - floor + 1]
    halves = number[capacity - floor + 1] - number[half + 1]
    room = halves * capacity - (total[capacity - floor + 1] - total[half + 1])
    over = np.maximum(0, total[half + 1] - total[floor] - room)
    return int((alone + halves + -(-over // capacity)).max())


def best_fit(counts: np.ndarray) -> list[tuple[Filling, int]]:
    """Best fit, longest first: each length goes where the least room is left, for all equal sequences at once."""
    capacity = len(counts) - 1
    rooms: dict[int, list[tuple[Filling, int]]] = {}
    open_ = np.zeros(capacity + 1, dtype=bool)

    def add(room: int, filling: Filling, n: int) -> None:
        if n:
            rooms.setdefault(room, []).append((filling, n))
            open_[room] = True

    for s in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[s])
        while n:
            fits = np.flatnonzero(open_[s:])
            if not len(fits):
                k = capacity // s
                add(capacity - k * s, ((s, k),), n // k)
                if n % k:
                    add(capacity - n % k * s, ((s, n % k),), 1)
                break
            room = s + int(fits[0])
            filling, many = rooms[room].pop()
            if not rooms[room]:
                open_[room] = False
            k = room // s
            full = min(many, n // k)
            add(room - k * s, (*filling, (s, k)), full)
            n, many = n - full * k, many - full
            if many and n and n < k:
                add(room - n * s, (*filling, (s, n)), 1)
                n, many = 0, many - 1
            add(room, filling, many)
    return [x for found in rooms.values() for x in found]


def fillings(counts: np.ndarray, room: int, slack: int) -> list[tuple[int, Filling]]:
    """(waste, filling) of room by lengths that are there, least waste first; none that another dominates.

    A filling is dominated if a length outside it could take the place of one or more of its lengths: of several whose
    sum it reaches, or of fewer with the room that is left.  A length that fits exactly dominates all else.  Lengths are
    tried from the longest; whatever is left is first closed by one or two lengths that fit exactly."""
    found: dict[Filling, int] = {}
    looks = 0

    def add(lengths: list[int], left: int) -> None:
        if left <= slack:
            found[tuple((s, lengths.count(s)) for s in sorted(set(lengths), reverse=True))] = left

    def grow(longest: int, left: int, chosen: list[int]) -> None:
        nonlocal looks
        looks += 1
        if not left or (left <= longest and counts[left]):
            return add([*chosen, *[left] * (left > 0)], 0)
        high = min(longest, left)
        sizes = np.flatnonzero(counts[: high + 1])[::-1]
        if not len(sizes):
            return add(chosen, left)
        other = left - sizes
        close = (other <= sizes) & (counts[other] > (other == sizes))
        if close.any():
            for a in sizes[close][:WIDTH].tolist():
                add([*chosen, a, left - a], 0)
            return
        for s in sizes.tolist():
            if looks > LOOKS or len(found) >= 3 * WIDTH:
                return
            counts[s] -= 1
            grow(s, left - s, [*chosen, s])
            counts[s] += 1

    grow(room, room, [])
    best: list[tuple[int, Filling]] = []
    for filling, left in sorted(found.items(), key=lambda x: (x[1], [(-s, -n) for s, n in x[0]])):
        if len(best) < WIDTH and not _dominated(counts, filling, left):
            best.append((left, filling))
    return best


def _dominated(counts: np.ndarray, chosen: Filling, left: int) -> bool:
    used = dict(chosen)
    sums = {0: 0}  # sum of a part of the filling: fewest lengths in it
    for s, n in chosen:
        for _ in range(min(n, 3)):
            for total, parts in list(sums.items())[:64]:
                sums.setdefault(total + s, parts + 1)
    for total, parts in sums.items():
        if not parts:
            continue
        high = min(len(counts) - 1, total + left)
        for x in (np.flatnonzero(counts[total : high + 1]) + total).tolist():
            if counts[x] > used.get(x, 0) and (x > total or parts > 1):
                return True
    return False


def completed(counts: np.ndarray, nodes: int = NODES) -> tuple[list[tuple[Filling, int]], int, int]:
    """Solution, its number of sequences, and the lower bound, by bin completion with best fit as the first incumbent."""
    counts = np.asarray(counts, dtype=np.int64).copy()
    capacity, least = len(counts) - 1, lower_bound(counts)
    best = best_fit(counts)
    most = sum(n for _, n in best)
    tokens = int((counts * np.arange(capacity + 1)).sum())
    # Each level: fillings still to be tried, and what the level has taken off the histogram.
    levels: list[tuple[list, tuple | None]] = []
    used = visited = 0

    def take(filling: Filling, n: int, sign: int) -> None:
        for s, k in filling:
            counts[s] -= sign * n * k

    def branches() -> list:
        left = lower_bound(counts)
        if used + left >= most:
            return []
        top = int(np.flatnonzero(counts)[-1])
        slack = (most - 1) * capacity - tokens - waste  # waste that a better solution may still have
        counts[top] -= 1
        options = fillings(counts, capacity - top, max(0, slack))
        counts[top] += 1
        out = []
        for lost, filling in options:
            whole = dict(filling)
            whole[top] = whole.get(top, 0) + 1
            many = min(int(counts[s]) // k for s, k in whole.items())
            if lost:
                many = min(many, slack // lost) if slack >= lost else 0
            if many:
                out.append((lost, tuple(sorted(whole.items(), reverse=True)), 1 if left <= SINGLE else many))
        return out[::-1]

    waste = 0
    levels.append((branches() if counts.any() else [], None))
    while levels and most > least and visited < nodes:
        options, _ = levels[-1]
        if not options:
            _, took = levels.pop()
            if took:
                lost, filling, n = took
                take(filling, n, -1)
                used, waste = used - n, waste - lost * n
            continue
        visited += 1
        lost, filling, n = options.pop()
        take(filling, n, 1)
        used, waste = used + n, waste + lost * n
        if not counts.any():
            if used < most:
                best, most = [(t[1], t[2]) for _, t in levels if t] + [(filling, n)], used
            take(filling, n, -1)
            used, waste = used - n, waste - lost * n
        else:
            levels.append((branches(), (lost, filling, n)))
    return best, most, least


# -- places


def placed(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """pieces (doc_id, piece, length, ids_crc32 and more; read three times) with sequence_id and offset.

    The histogram that comes to the driver has at most ``capacity`` rows, and the table of places that goes to the tasks
    a few for each of them."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[length] = n
    solution, _, _ = completed(counts, nodes)
    rank, first, entries = [0] * (capacity + 1), 0, []
    for filling, n in solution:
        at = 0
        for s, k in filling:
            entries.append((s << 44 | rank[s], k, first, at, s))
            rank[s] += n * k
            at += s * k
        first += n
    table = spark.sparkContext.broadcast(np.array(sorted(entries), dtype=np.int64).reshape(-1, 5))
    chunks = max(8, shuffle_partitions(spark) // 4, int(counts.sum()) // 100_000)
    ranked = numbered(pieces, ["length"], [F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")], F.struct("doc_id", "piece"), chunks, F.lit(1).cast("long"), "__rank")

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        known = table.value
        key, ranks = length.to_numpy(np.int64) << 44, rank.to_numpy(np.int64)
        row = known[np.searchsorted(known[:, 0], key | ranks, side="right") - 1]
        turn = ranks - (row[:, 0] & (1 << 44) - 1)
        return pd.DataFrame({"sequence_id": row[:, 2] + turn // row[:, 1], "offset": row[:, 3] + turn % row[:, 1] * row[:, 4]})

    return ranked.withColumn("__at", place("length", "__rank")).select(*pieces.columns, "__at.sequence_id", "__at.offset")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids of every piece."""
    return placed(cut(tokenised(docs, path, capacity, end, id_col, text_col, keep_ids)), capacity, nodes)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids and the starts of its pieces, of packed pieces with their ids; a group is one sequence."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), held.alias("p")).select("sequence_id", "length", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))
