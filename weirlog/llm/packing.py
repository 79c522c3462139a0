"""Packing documents into fixed token windows by an order-preserving dynamic program with a monotone queue."""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship

WINDOW = 2048
END_ID = 1
#: Price, in padding tokens, of a cut at a sentence's end, of one inside a sentence, and of a half-size window.
SENTENCE_CUT, HARD_CUT, HALF_WINDOW = 12.0, 96.0, 24.0
#: Where no sentence ends for this many tokens, cuts are offered every HARD_STEP tokens.
LONGEST, HARD_STEP = 512, 256
#: Tokens gathered before the dynamic program runs; what its last windows hold is carried on.
BUFFER = 64 * WINDOW
FLUSH_BYTES = 4 << 20
#: Texts with longer words or runs of white space go through the tokenizer file: the rank encoder takes
#: time with the square of a piece's length, and gives up on very long ones.
LONGEST_PIECE = 400
_BLANKS = re.compile(r"\s{%d}" % LONGEST_PIECE)
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


@lru_cache(maxsize=2)
def _tokenizer(path: str, ranks_path: str, pattern: str):
    """(encode, ends): a text's ids as an array; for each id, whether a sentence ends with it.

    The rank file holds the same vocabulary for a faster encoder. Texts that contain an added token's string, whose
    rules differ, texts with long pieces, and whatever the faster encoder refuses go through the tokenizer file.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    ends = np.zeros(max(max(ranks.values()), slow.get_vocab_size()) + 2, dtype=bool)
    for token, i in ranks.items():
        ends[i] = token[-1:] in (b".", b"!", b"?", b"\n")

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special) and not _long_pieces(text):
            try:
                return np.asarray(fast.encode_to_numpy(text), dtype=np.uint32)
            except Exception:  # noqa: BLE001 - any refusal: the tokenizer file decides
                pass
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode, ends


def _long_pieces(text: str) -> bool:
    words = [len(w) for w in text.split()]
    return max(words, default=0) > LONGEST_PIECE or (len(text) - sum(words) - len(words) > LONGEST_PIECE and _BLANKS.search(text) is not None)


def _candidates(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut after, as numbers of ids from the document's start, and their prices; the document's end is last."""
    n = len(ids)
    at = np.flatnonzero(ends[ids[: max(n - 2, 0)]]) + 1
    price = np.full(len(at), SENTENCE_CUT)
    edge = np.concatenate(([0], at, [n]))
    for i in np.flatnonzero(np.diff(edge) > LONGEST):
        hard = np.arange(edge[i] + HARD_STEP, edge[i + 1] - 1, HARD_STEP)
        at, price = np.concatenate((at, hard)), np.concatenate((price, np.full(len(hard), HARD_CUT)))
    order = np.argsort(at, kind="stable")
    return np.concatenate((at[order], [n])), np.concatenate((price[order], [0.0]))


def best_cuts(at: list[int], price: list[float], window: int, final: bool) -> list[int]:
    """Cuts (values of at) that minimise padding plus prices, from 0; unless final, up to the best late cut.

    cost(j) = min over i within a window of cost(i) + window - (at[j] - at[i]) + price[j]; cost(i) + at[i] is kept in
    a queue of rising values, so each candidate enters and leaves once. A window of exactly half size needs no padding.
    """
    cost, back, pos = [0.0], [-1], [0, *at]
    where = {0: 0}
    queue: deque[int] = deque([0])
    half = window // 2
    for j in range(1, len(pos)):
        t = pos[j]
        while queue and pos[queue[0]] < t - window:
            queue.popleft()
        i = queue[0]
        c = cost[i] + (window - (t - pos[i]))
        k = where.get(t - half)
        if k is not None and cost[k] + HALF_WINDOW < c:
            i, c = k, cost[k] + HALF_WINDOW
        c += price[j - 1]
        cost.append(c)
        back.append(i)
        where[t] = j
        v = c + t
        while queue and cost[queue[-1]] + pos[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    j = len(pos) - 1
    if not final:
        late = [k for k in range(1, len(pos)) if pos[k] > pos[-1] - window]
        j = min(late, key=lambda k: (cost[k], -k))
    cuts = []
    while j > 0:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def _pack(batches: Iterator[pa.RecordBatch], path: str, ranks_path: str, pattern: str, window: int) -> Iterator[pa.RecordBatch]:
    encode, ends = _tokenizer(path, ranks_path, pattern)
    first = TaskContext.get().partitionId() << 40
    docs: deque[list] = deque()  # [doc_id, ids, ids already placed, cut places, prices]
    state = {"tokens": 0, "sequence": 0}
    rows: dict[str, list] = {name: [] for name in PIECES.names}
    held = 0

    def place(final: bool) -> None:
        nonlocal held
        at, price, base = [], [], 0
        for d in docs:
            keep = np.searchsorted(d[3], d[2], side="right")
            at += (d[3][keep:] - d[2] + base).tolist()
            price += d[4][keep:].tolist()
            base += len(d[1]) - d[2]
        begin = 0
        for cut in best_cuts(at, price, window, final):
            room, offset = cut - begin, 0
            while room:
                d = docs[0]
                n = min(room, len(d[1]) - d[2])
                piece = d[1][d[2] : d[2] + n].astype("<u4").tobytes()
                for name, v in zip(PIECES.names, (d[0], d[2], piece, len(d[1]), first + state["sequence"], offset), strict=True):
                    rows[name].append(v)
                held += len(piece) + 48
                d[2] += n
                offset += n
                room -= n
                if d[2] == len(d[1]):
                    docs.popleft()
            state["sequence"] += 1
            state["tokens"] -= offset
            begin = cut

    def flush() -> pa.RecordBatch:
        nonlocal held
        out = pa.record_batch([pa.array(rows[f.name], f.type) for f in PIECES], schema=PIECES)
        for v in rows.values():
            v.clear()
        held = 0
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
            docs.append([doc_id.as_py(), ids, 0, *_candidates(ids, ends)])
            state["tokens"] += len(ids)
            if state["tokens"] >= BUFFER:
                place(False)
            if held >= FLUSH_BYTES:
                yield flush()
    if docs:
        place(True)
    if held:
        yield flush()


def pack_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """Cut documents into pieces and pack them, in input order, into sequences of at most `window` ids.

    A document is its ids and END_ID. Each scan partition is packed by itself as a stream, so nothing is shuffled and
    at most BUFFER ids (and one document) are held; only a partition's last sequence is padded for want of more.
    Cuts fall at document ends for nothing, at sentence ends for a small price, inside a sentence for a high one and
    only where none ends for LONGEST ids. A sequence of half a window, a power of two, needs no padding.

    Null or empty text: END_ID alone. Null and repeated ids are carried as they are. Empty table: no rows. Other
    columns are not read. Returns pieces (doc_id, start, ids as little-endian 32-bit, doc_tokens, sequence_id, offset).
    """
    import public_tokenizers as files

    ship(docs.sparkSession)
    path, ranks_path, pat = tokenizer or files.path("byte_bpe_50k.json"), ranks or files.path("byte_bpe_50k.tiktoken"), pattern or files.PATTERN
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, path, ranks_path, pat, window), "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return p.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
