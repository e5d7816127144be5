"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has limits on tokens, segments and loss-bearing tokens.  A document's whole sequences are cut off first;
what remains of the documents of a window is packed sequence by sequence: of the pieces that fit, the one whose demand
has the largest dot product with the room left (both as shares of the limits) goes in; when none fits, the piece with
the largest product is cut to the room.  A sequence that can't be filled is cut into powers of two, so nothing is
padded.  Each task packs its own documents in windows of bounded size: no shuffle, and a lost task is just run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, per_worker
from .tokens import WordIds

_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()), ("ids", pa.binary())])


def arrange(lengths: np.ndarray, loss_from: np.ndarray, tokens: int, segments: int, loss: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of every document once.

    ``loss_from``: how many of a document's tokens, from its start, bear no loss.  Every sequence is full, or has a
    power of two of tokens.
    """
    limit = np.array([tokens, segments, loss], float)
    at = np.zeros(len(lengths), np.int64)
    out: list[list[tuple[int, int, int]]] = []
    whole = lengths // tokens if loss >= tokens and segments >= 1 else lengths * 0
    for d in np.flatnonzero(whole):
        out += [[(int(d), int(k) * tokens, tokens)] for k in range(whole[d])]
    at += whole * tokens
    left = np.flatnonzero(lengths > at)
    # Pieces of equal demand are one kind, so a choice costs the kinds, not the pieces.
    kinds: dict[tuple[int, int], list[int]] = {}
    for d in left.tolist():
        n = int(lengths[d] - at[d])
        kinds.setdefault((n, int(min(n, max(0, lengths[d] - max(at[d], loss_from[d]))))), []).append(d)
    size = np.array(list(kinds), np.int64).reshape(-1, 2)
    alive = np.ones(len(size), bool)

    def add(d: int) -> None:
        nonlocal size, alive
        n = int(lengths[d] - at[d])
        key = (n, int(min(n, max(0, lengths[d] - max(at[d], loss_from[d])))))
        if key not in kinds:
            kinds[key] = []
            size, alive = np.r_[size, [key]], np.r_[alive, False]
        kinds[key].append(d)
        alive[np.flatnonzero((size == key).all(1))[0]] = True

    while alive.any():
        now: list[tuple[int, int, int]] = []
        room = limit.copy()
        while room[0] > 0 and room[1] > 0 and alive.any():
            use = np.flatnonzero(alive)
            demand = size[use]
            product = demand[:, 0] * (room[0] / limit[0] ** 2) + room[1] / limit[1] ** 2 + demand[:, 1] * (room[2] / limit[2] ** 2)
            fits = (demand[:, 0] <= room[0]) & (demand[:, 1] <= room[2])
            last = room[1] == 1 and not (fits & (demand[:, 0] == room[0])).any()
            k = int(use[np.argmax(np.where(fits, product, -1.0) if fits.any() and not last else product)])
            d = kinds[tuple(size[k].tolist())][-1]
            n = min(int(size[k, 0]), int(room[0]))
            silent = max(0, int(loss_from[d] - at[d]))
            n = min(n, silent + int(room[2]))
            if n <= 0:
                break
            kinds[tuple(size[k].tolist())].pop()
            alive[k] = bool(kinds[tuple(size[k].tolist())])
            now.append((d, int(at[d]), n))
            room -= [n, 1, max(0, n - silent)]
            at[d] += n
            if at[d] < lengths[d]:
                add(d)
        out += powers(now, tokens)
    return out


def powers(pieces: list[tuple[int, int, int]], tokens: int) -> list[list[tuple[int, int, int]]]:
    """One full sequence as it is; else sequences of powers of two, largest first."""
    total = sum(n for _, _, n in pieces)
    out, at = [], 0
    sizes = [tokens] if total == tokens else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    queue = list(pieces)
    for size in sizes:
        now = []
        while size:
            d, start, n = queue[at]
            take = min(n, size)
            now.append((d, start, take))
            size -= take
            if take == n:
                at += 1
            else:
                queue[at] = (d, start + take, n - take)
        out.append(now)
    return out


def _pack(tokenizer: str, end: int, tokens: int, segments: int, loss: int, window: int, wanted: bool):
    def run(batches):
        encoder = per_worker("word ids", tokenizer, lambda: WordIds(tokenizer))
        task, made = TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u4").tobytes()

        def flush(ids, docs, skips):
            nonlocal made
            lengths = np.array([len(x) // 4 for x in docs], np.int64)
            rows = []
            for k, pieces in enumerate(arrange(lengths, np.minimum(skips, lengths), tokens, segments, loss)):
                offset = 0
                for d, start, n in pieces:
                    bearing = max(0, start + n - max(start, min(skips[d], int(lengths[d]))))
                    rows.append((ids[d], start, n, int(lengths[d]), (task << 32) + made + k, offset, bearing, docs[d][4 * start : 4 * (start + n)] if wanted else None))
                    offset += n
            made += len({r[4] for r in rows})
            for a in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 4096]), _OUT)], schema=_OUT)

        ids, docs, skips, size = [], [], [], 0
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                prompt = encoder.encode((column["prompt"][i].as_py() or "").encode()) if "prompt" in column else b""
                ids.append(column["doc_id"][i].as_py())
                docs.append(prompt + encoder.encode((column["text"][i].as_py() or "").encode()) + tail)
                skips.append(len(prompt) // 4)
                size += len(docs[-1]) // 4
                if size >= window:
                    yield from flush(ids, docs, skips)
                    ids, docs, skips, size = [], [], [], 0
        if ids:
            yield from flush(ids, docs, skips)

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 1, tokens: int = 2048, segments: int = 256, loss: int | None = None, prompt: str | None = None, window: int = 1 << 21, ids: bool = True) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, loss_tokens, ids): one row per piece.

    ``prompt`` names a column whose tokens come first and bear no loss (instruction data); without it every token
    bears loss.  ``loss`` limits loss-bearing tokens of a sequence (none: as many as tokens).  ``ids`` are the piece's
    token ids, little-endian unsigned 32-bit.  A null or empty text is its end token alone.  Repeated rows are packed
    each; null doc_ids are kept.  An empty table gives no rows; other columns are ignored.
    ``window`` tokens are packed together, which bounds memory; a longer document is a window of its own.
    """
    bounded_batches(docs.sparkSession)
    if min(tokens, segments, loss or 1) < 1:
        raise ValueError("limits must be positive")
    use = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")] + ([F.col(prompt).cast("string").alias("prompt")] if prompt else [])
    run = _pack(tokenizer, end, tokens, segments, loss or tokens, window, ids)
    return docs.select(*use).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary")
