"""Byte-level BPE encoding and decoding over overlapping chunks.

A text up to ``CHUNK`` characters is one piece. A longer one is cut into chunks that overlap by
``OVERLAP`` characters; the chunks are spread over the cluster and pre-tokenised in parallel.
Two scans that have a boundary in common agree from there on, as the pattern never looks back: so
neighbouring chunks are stitched at the first boundary that both have in their overlap. Where
there is none (a word or a run of blanks longer than the overlap), the chunk joins the piece before it,
until scans meet again. The pieces are encoded on their own, each match of the pattern by merging
its bytes in order of rank. Decoding concatenates the bytes of the tokens.

A boundary near the cut end of a chunk is not trusted: a match may change with up to three
characters after it. Once a chunk is not stitched, later boundaries of it are not known to be
right either, so the piece runs on to the end of the text: right, if slower.

Cases: a null or empty text has no ids and decodes to no bytes; text without any match has
none; special tokens are ordinary text; repeated rows are encoded each on their own; an empty table gives
an empty result; other columns do not matter.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from array import array
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import whole_text, with_fields

CHUNK, OVERLAP, MARGIN = 1 << 15, 1 << 10, 4
CACHE = 500_000  # distinct matches remembered in a worker process, some 100 MB
WIDTHS = (8, 12, 16, 24, 40, 64)  # bytes of matches that are merged together
MERGED = 16_384  # matches merged at a time
ROWS, LONG_ROWS = 256, 32  # rows of an output batch: of short texts, of pieces of long ones


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Merger:
    """Ids of matches: the neighbouring pair of lowest rank merges first, the leftmost of equals.

    Short matches are merged many at a time, one pair of each in a step: a row of ids and a row
    of the ids that neighbours would merge to, which are their ranks too. Longer ones take a heap.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.ranks, self.none = ranks, 1 + max(ranks.values(), default=0)
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        splits = {(left << 32) | right: rank for token, rank in ranks.items() for i in range(1, len(token))
                  if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}
        self.pairs = np.array(sorted(splits) or [-1], np.int64)
        self.merged = np.array([splits.get(p, self.none) for p in self.pairs.tolist()], np.int64)

    def merge_ids(self, left, right):
        """What neighbours merge to, or ``none``. Ids of -1 are no neighbours."""
        import numpy as np

        pair = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == pair), self.merged[at], self.none)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as four bytes each, of matches of 2 to ``width`` bytes."""
        import numpy as np

        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[raw], -1)
        ids = np.concatenate([ids, np.full((len(ids), 1), -1)], 1)
        low = self.merge_ids(ids[:, :-1], ids[:, 1:])
        done, rows = np.full((len(ids), width), -1, np.int32), np.arange(len(ids))
        while len(rows):
            at = low.argmin(1)
            every = np.arange(len(rows))
            best = low[every, at]
            if not (more := best < self.none).all():
                done[rows[~more]] = ids[~more, :-1]
                ids, low, rows, at, best = ids[more], low[more], rows[more], at[more], best[more]
                every = np.arange(len(rows))
            ids[every, at] = best
            behind = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, behind, 1)
            low[:, :-1] = np.take_along_axis(low, np.minimum(behind[:, :-1], width - 1), 1)
            low[every, at] = self.merge_ids(best, ids[every, at + 1])
            before = np.maximum(at - 1, 0)
            low[every, before] = np.where(at > 0, self.merge_ids(ids[every, before], best), low[every, before])
        counts = (done >= 0).sum(1).tolist()
        return [row[:n].tobytes() for row, n in zip(done, counts, strict=True)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as four bytes each, of every match."""
        out, by_width = [b""] * len(pieces), {w: [] for w in WIDTHS}
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = array("i", [whole]).tobytes()
            elif (width := next((w for w in WIDTHS if len(piece) <= w), None)) is not None:
                by_width[width].append(k)
            else:
                out[k] = array("i", merge_long(piece, self.ranks)).tobytes()
        for width, places in by_width.items():
            for start in range(0, len(places), MERGED):
                some = places[start:start + MERGED]
                for k, ids in zip(some, self.merge_rows([pieces[k] for k in some], width), strict=True):
                    out[k] = ids
        return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A heap of pairs, for matches of any length."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # starts of the neighbouring parts
    end = list(range(1, n + 1))  # end of the part that starts here, 0 once it is merged away
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or ranks.get(piece[i:end[j]]) != rank:
            continue  # the pair has changed meanwhile
        end[i], end[j], after[i] = end[j], 0, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i:end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end[i]])) is not None:
            heapq.heappush(heap, (r, h))
    return [ranks[piece[i:e]] for i, e in enumerate(end) if e]


class Encoder:
    """Ranks, the merger, and the ids of matches met before, remembered up to a bound."""

    def __init__(self, ranks_file: bytes):
        self.ranks = load_ranks(ranks_file)
        self.spelling = {rank: token for token, rank in self.ranks.items()}
        self.merger, self.known = Merger(self.ranks), {}

    def encode(self, found: list[list[str]]) -> list[bytes]:
        """Ids, as four bytes each, of texts given by their matches."""
        known = self.known
        new = list({m for matches in found for m in matches if m not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({m for matches in found for m in matches})
        known.update(zip(new, self.merger.merge([m.encode() for m in new]), strict=True))
        return [b"".join(map(known.__getitem__, matches)) for matches in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))


@functools.lru_cache(maxsize=1)
def encoder(ranks_file: bytes) -> Encoder:
    """One for all tasks of a worker process, which so remembers matches from task to task."""
    return Encoder(ranks_file)


# Letters and numbers that came after Unicode 16.0, the tokenizer library's version;
# for it they are neither. (first, last) code points.
NEWER = """558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2
a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1
1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2
18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de
1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""


class Matches:
    """The matches of a pattern, by the tokenizer library's Unicode version."""

    def __init__(self, pattern: str):
        import regex

        ranges = [r.split("-") for r in NEWER.split()]
        self.newer = re.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in ranges) + "]")
        self.high = re.compile(f"[{chr(int(ranges[0][0], 16))}-\U0010ffff]")  # none of these: nothing newer either
        spelled = (pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                   .replace(r"\S", r"\P{White_Space}"))  # other libraries' \s has more or fewer characters
        self.pattern = regex.compile(spelled)

    def has_newer(self, text: str) -> bool:
        return bool(self.high.search(text) and self.newer.search(text))

    def spans(self, text: str):
        shadow = self.newer.sub("\uffff", text) if self.has_newer(text) else text
        return [m.span() for m in self.pattern.finditer(shadow)]

    def texts(self, text: str) -> list[str]:
        if self.has_newer(text):
            return [text[a:b] for a, b in self.spans(text)]
        return self.pattern.findall(text)


def split_chunks(batches):
    """Overlapping chunks of long texts."""
    import pandas as pd

    for batch in batches:
        for row in batch.itertuples(index=False):
            count = -(-len(row.text) // CHUNK)
            for start in range(0, count, ROWS):
                numbers = range(start, min(count, start + ROWS))
                yield pd.DataFrame({
                    "uid": row.uid, "id": row.id, "chunk": list(numbers), "last": [c == count - 1 for c in numbers],
                    "text": [row.text[c * CHUNK:(c + 1) * CHUNK + OVERLAP] for c in numbers]})


def scan_chunks(pattern: str):
    """Boundaries of a chunk's scan in its first and in its last OVERLAP characters, from its start."""
    def scan(batches):
        matches = Matches(pattern)
        for batch in batches:
            heads, tails = [], []
            for text, last in zip(batch["text"], batch["last"], strict=True):
                trusted = len(text) if last else len(text) - MARGIN
                ends = [end for _, end in matches.spans(text)]
                heads.append([0] + [e for e in ends if e <= OVERLAP and e <= trusted])
                tails.append([e - CHUNK for e in ends if CHUNK <= e <= trusted])
            yield batch.assign(head=heads, tail=tails)

    return scan


def stitched_pieces(long: DataFrame, pattern: str) -> DataFrame:
    """(uid, id, piece, text) of long texts (uid, id as a string, text)."""
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = "uid bigint, id string, chunk bigint, last boolean, text string"
    chunks = long.select("uid", "id", "text").mapInPandas(split_chunks, fields)
    scanned = chunks.repartition(parts, "uid", "chunk").mapInPandas(
        scan_chunks(pattern), fields + ", head array<int>, tail array<int>")
    order = Window.partitionBy("uid").orderBy("chunk")
    meet = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    linked = scanned.withColumn("meet", meet).withColumn("own", F.lag("meet").over(order))
    # A chunk is known to be in step while every chunk before it has been stitched.
    broken = F.max(((F.col("chunk") > 0) & F.col("own").isNull()).cast("int")).over(order)
    state = linked.withColumn("broken", broken).withColumn(
        "next_broken", F.coalesce(F.lead("broken").over(order), F.lit(0)))
    begin = F.when((F.col("chunk") == 0) | (F.col("broken") == 1), 0).otherwise(F.col("own"))
    stop = (F.when(F.col("last"), F.char_length("text")).when(F.col("next_broken") == 1, F.lit(CHUNK))
            .otherwise(F.col("meet") + CHUNK))
    piece = F.max(F.when(F.col("broken") == 0, F.col("chunk"))).over(order)
    cut = state.select("uid", "id", piece.alias("piece"), "chunk",
                       F.substring(F.col("text"), begin + 1, stop - begin).alias("text"))
    return (cut.groupBy("uid", "id", "piece").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("t"))
            .select("uid", "id", "piece", F.array_join(F.col("t.text"), "").alias("text")))


def encode_pieces(pieces: DataFrame, keep: list[str], ranks_file: bytes, pattern: str, rows: int = ROWS) -> DataFrame:
    """``keep``, ``ids`` and ``decoded`` (the bytes that the ids stand for) of each ``text``."""
    schema = with_fields(pieces.select(*keep), "ids array<int>, decoded binary")

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        coder, find = encoder(ranks_file), Matches(pattern).texts
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids = coder.encode([find(t) for t in batch.column("text").to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                values = np.frombuffer(b"".join(ids), np.int32)
                decoded = [coder.decode(np.frombuffer(x, np.int32).tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                     pa.array(decoded, pa.binary())], [*keep, "ids", "decoded"])

    return pieces.select(*dict.fromkeys([*keep, "text"])).mapInArrow(encode, schema)


def digests(ids: Column, decoded: Column) -> list[Column]:
    joined = F.array_join(ids.cast("array<string>"), ",")
    return [F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
            F.sha2(decoded, 256).alias("decoded_sha256")]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Whole texts (doc_id, ids, decoded), and pieces of long ones (uid, doc_id, piece, ids, decoded).

    ``uid`` is one number per row of ``docs``; its pieces follow each other in order of ``piece``.
    """
    ranks_file = Path(ranks_path).read_bytes()  # under 1 MB, travels with the job
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text)).alias("text"))
    short = rows.filter(F.char_length("text") <= CHUNK)
    long = rows.filter(F.char_length("text") > CHUNK).select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("string").alias("id"), "text")
    pieces = encode_pieces(stitched_pieces(long, pattern), ["uid", "id", "piece"], ranks_file, pattern, LONG_ROWS)
    back = F.col("id").cast(rows.schema["doc_id"].dataType).alias("doc_id")
    return (encode_pieces(short, ["doc_id"], ranks_file, pattern),
            pieces.select("uid", back, "piece", "ids", "decoded"))


def encoded_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    short, pieces = encode_documents(docs, ranks_path, pattern)
    ordered = F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded")))
    whole = pieces.groupBy("uid", "doc_id").agg(ordered.alias("p")).select(
        "doc_id", F.flatten("p.ids").alias("ids"),
        F.unhex(F.array_join(F.transform("p.decoded", F.hex), "")).alias("decoded"))
    return short.select("doc_id", "ids", "decoded").unionByName(whole).select(
        "doc_id", *digests(F.col("ids"), F.col("decoded")))
